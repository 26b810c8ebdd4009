"""Word lists, patterns and limits that results depend on. All are defaults of parameters.

Patterns avoid what Java, RE2 and Python read differently; places where they do differ are noted at the operator.
"""

from __future__ import annotations

# Page kinds and structure.
SCANNED_BELOW, HYBRID_BELOW = 20, 200
TOC_LINES, STRUCTURE_THRESHOLD, NOISY_THRESHOLD = 3, 3, 4
BOOKMARK_WEIGHT, TOC_WEIGHT, HEADING_WEIGHT = 3, 2, 1
WORD_PAGE_CHARS = 3000

# Fact windows and display lengths, in characters.
EVENT_WINDOW, CONTEXT, LABEL, LINE_LABEL, EVENT_TEXT, SECTION_TEXT = 400, 450, 160, 100, 300, 400
DATE_SLACK, WORD_FIGURE_SLACK = 20, 40
LINE_MIN, LINE_MAX, SENTENCE_REACH = 20, 600, 500
MIN_SENTENCE, SENTENCES_PER_PARAGRAPH, TOP_SENTENCES = 20, 3, 1
ACT_WINDOW, ACT_NAME_MAX = 160, 120

# The graph.
HUB, TOP_K, MIN_SCORE, HORIZON_DAYS = 40, 5, 0.35, 180
W_ENTITY, W_TIME, W_TEXT, W_SAME, SAME_BONUS = 0.35, 0.20, 0.35, 0.10, 0.1
FUZZY_ENTITY, FUZZY_VERSUS, FUZZY_CUE, FUZZY_ACT, FUZZY_CUE_MIN = 88, 70, 88, 90, 16

# Patterns of headings, tables of contents, page furniture and mentions.
HEADING = (
    r"(?i)^\s*(?:(?:[IVXLCDM]{1,7}|\d{1,2})[.)]\s*)?"
    r"(?:ANNEXURE[\s\-–]*[A-Z0-9\-/]+|EXHIBIT\s+[A-Z0-9\-]+|AFFIDAVIT|SYNOPSIS|LIST OF DATES(?:\s+AND\s+EVENTS)?|WRITTEN STATEMENT|"
    r"(?:INTERIM\s+|FINAL\s+|ADDITIONAL\s+|MAIN\s+)?PRAYER(?:\s+FOR\s+RELIEF)?|GROUNDS(?:\s+FOR\s+INTERIM\s+RELIEF)?|INTERIM\s+RELIEF|"
    r"QUESTIONS?(?:\(S\))? OF LAW|MEMO OF PARTIES|INDEX|VAKALATNAMA)\s*[:.]?\s*$"
)
TOC_DOTTED = r"^.{3,90}?[.·]{3,}\s*\d{1,4}\s*$"
TOC_COLUMNS = r"^\s*(?:\d{1,2}[.)]\s+)?.{5,80}?\s{2,}\d{1,4}\s*$"
PAGE_FOOTER = r"(?i)\b[A-Z][A-Za-z.]{0,3}(?:\.[A-Z][A-Za-z.]{0,3}){0,3}\s*\(?[A-Z]{0,6}\)?\s*\d{1,6}\s*/\s*\d{4}\s+Page\s+\d+\s+of\s+\d+\b\.?"
SIGNATURE_STAMP = r"(?i)\s*Digitally\s+Signed(?:\s+By\s*:?\s*[A-Za-z][A-Za-z .]*)?"
AMOUNT = r"(?i)(?:Rs\.?|₹|INR)\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:lakh|lakhs|crore|crores))?"
AMOUNT_PARTS = r"(?i)(?:Rs\.?|₹|INR)\s?(\d[\d,]*(?:\.\d+)?)(?:\s?(lakh|lakhs|crore|crores))?"
SECTION_NUMBER = r"(?i)\b(?:section|sec\.?|s\.)\s?(\d+[A-Z]{0,2})\b"
ACT_OF = r"(?i)\b(?:the\s+)?([A-Z][A-Za-z.\s]{2,60}?Act(?:,\s*\d{4})?)"
#: How statutes are named near a citation: %s is the word that ends a name.
ACT_AROUND = r"(?i)\b(?:the\s+)?([A-Z][A-Za-z.\s]{2,60}?%s(?:,\s*\d{4})?)"
ACT_RUN = r"([A-Z][\w&/,.\-]*(?:\s+[A-Z][\w&/,.\-]*){0,4}\s+%s(?:,\s*\d{4})?)$"
CASE_NUMBER = r"(?i)\b(?:C\.?S\.?|W\.?P\.?|Crl\.?|C\.?A\.?|SLP|O\.?A\.?)\s?(?:\(\w+\)\s?)?No\.?\s?\d+\s?(?:of|[/-])\s?\d{2,4}\b"
PROVISION = r"(?i)\b(?:Section|Sec\.?|S\.)\s?\d+[A-Z]{0,2}\b|\bOrder\s+[IVXL]+\s+Rule\s+\d+\b"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = (
    rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?[\s.]+(?:{MONTHS})[a-z]*[\s.,]+\d{{4}}\b"
    rf"|\b(?:{MONTHS})[a-z]*[\s.]+\d{{1,2}}(?:st|nd|rd|th)?[\s.,]+\d{{4}}\b"
    r"|\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"
)
WORD_AMOUNT = r"(?i)(?:Rs\.?|rupees?|INR)\s+(?:[A-Za-z]+[\s,\-]+){1,12}?(?:hundred|thousand|lakhs?|crores?)(?:\s+only)?"
NUMBERED_PARAGRAPH = r"^\s*\d{1,3}\.\s+\S"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9])"
FURNITURE_LINE = r"(?i)^(equivalent citations|author|bench|reportable|source:)\b"
REPORTER_CITATION = r"(?i)\bAIR\s+\d{4}\b|\bAIRONLINE\b"
PROVISION_HEADING = r"(?i)\bPRAYER\b|\bGROUNDS\b|\bRELIEF\b|QUESTIONS?.*OF LAW"
ACT_ACRONYM = r"\b(IPC|Cr\.?\s?P\.?\s?C\.?|C\.?P\.?C\.?|IEA)\b"
LEGAL_SUFFIX = r"\b(?:pvt|private|ltd|limited|llp|inc|incorporated|corp|corporation|co|company|&|and|sons|enterprises|industries)\b\.?"

# Abbreviations that end no sentence.
ABBREVIATIONS = "rs no nos s ss sec secs art arts mr mrs dr smt shri vs v ors anr crl slp addl dy govt ltd co hon para paras regd adv sd w.e.f i.e e.g etc u/s u/a".split()

# Event types and their phrases.
EVENT_PHRASES = {
    "PAYMENT": ("paid", "payment of", "transferred", "remitted", "received a sum"),
    "TERMINATION": ("terminated", "termination of", "revoked", "rescinded"),
    "NOTICE": ("legal notice", "hereby notified", "notice dated", "served a notice"),
    "AGREEMENT": ("agreement dated", "entered into", "executed an agreement"),
    "ORDER": ("it is ordered", "the court directs", "order dated", "hereby directed"),
    "FILING": ("filed on", "instituted", "presented before"),
}
# Verbs of the parsed facts, with their types.
EVENT_VERBS = {
    "pay": "PAYMENT", "remit": "PAYMENT", "transfer": "PAYMENT", "receive": "PAYMENT",
    "terminate": "TERMINATION", "revoke": "TERMINATION", "rescind": "TERMINATION", "cancel": "TERMINATION",
    "notify": "NOTICE", "serve": "NOTICE",
    "execute": "AGREEMENT", "sign": "AGREEMENT", "enter": "AGREEMENT",
    "order": "ORDER", "direct": "ORDER", "hold": "ORDER", "rule": "ORDER",
    "file": "FILING", "institute": "FILING", "present": "FILING",
}
MODALS = "will would could shall may should must can might".split()
# Polarity phrases and verbs.
DENIALS = ("denies", "denied", "no such", "did not receive", "never received", "false and baseless", "wrongly alleged", "disputed")
ASSERTIONS = ("states that", "submits that", "acknowledges", "confirms", "admits", "it is averred")
DENIAL_VERBS = "deny dispute refute contest rebut refuse".split()
ASSERTION_VERBS = "state submit acknowledge confirm admit aver contend assert allege".split()

# Rhetorical roles in order, their cues, and the roles that carry on to later paragraphs.
ROLE_CUES = {
    "FACTS": ("the facts of the case", "brief facts are", "briefly stated", "facts leading to", "facts giving rise to", "the facts relevant", "facts of this case"),
    "ISSUES": ("question for consideration", "issue that arises", "issues involved", "the question is whether", "point for determination", "main issue"),
    "ARGUMENTS_PETITIONER": ("learned counsel for the petitioner", "learned counsel for the appellant", "it is submitted by the petitioner", "it is contended by the appellant", "counsel for the appellant submits", "counsel for the petitioner"),
    "ARGUMENTS_RESPONDENT": ("learned counsel for the respondent", "it is submitted by the respondent", "on behalf of the respondent", "counsel for the respondent"),
    "PRECEDENT": ("relied upon the judgment", "reported in", "this court held in", "cited the decision"),
    "ANALYSIS": ("we have considered", "having heard", "we are of the view", "in our opinion", "having perused", "we have heard", "we have examined"),
    "RULING": ("in view of the above", "for the reasons stated", "it is ordered", "the appeal is dismissed", "the appeal is allowed", "the petition is dismissed", "the petition is allowed", "we dismiss", "we allow"),
}
CARRIED_ROLES = ("FACTS", "ISSUES", "ARGUMENTS_PETITIONER", "ARGUMENTS_RESPONDENT", "ANALYSIS", "RULING")

# Names that are no entities.
GENERIC_NAMES = (
    "court", "the court", "high court", "the high court", "sessions court", "the sessions court", "supreme court", "the supreme court",
    "the supreme court of india", "versus", "order", "notice", "judgment", "appeal", "justice", "adv", "slp", "anr", "union of india",
)
# Statutes that are cited by acronym.
ACRONYMS = {"IPC": "Indian Penal Code, 1860", "CRPC": "Code of Criminal Procedure, 1973", "CPC": "Code of Civil Procedure, 1908", "IEA": "Indian Evidence Act, 1872"}
# Number words.
NUMBER_WORDS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True)) | dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
SCALE_WORDS = {"hundred": 100, "thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "crore": 10_000_000, "crores": 10_000_000}


def inflections(verb: str) -> list[str]:
    """A regular verb's forms, and the irregular ones of the lists above."""
    odd = {"pay": ["paid"], "hold": ["held"], "rebut": ["rebutted", "rebutting"], "submit": ["submitted", "submitting"], "admit": ["admitted", "admitting"], "aver": ["averred", "averring"], "remit": ["remitted", "remitting"], "transfer": ["transferred", "transferring"], "cancel": ["cancelled", "cancelling"]}
    if verb.endswith("y") and verb[-2] not in "aeiou":
        forms = [verb, verb[:-1] + "ies", verb[:-1] + "ied", verb + "ing"]
    elif verb.endswith("e"):
        forms = [verb, verb + "s", verb + "d", verb[:-1] + "ing"]
    else:
        forms = [verb, verb + "s", verb + "ed", verb + "ing"]
    return forms + odd.get(verb, [])

# Captions: words between two sides, scan errors, role names and markers, roles by case type.
VERSUS_FORMS = (r"v\s*/\s*s", r"vs?\.?", r"versus", r"verses", r"vers[tu]s", r"ver[sz]us", r"\bv\b", r"बनाम", r"विरुद्ध", r"विरूद्ध", r"எதிர்", r"వర్సెస్")
SCAN_FIXES = {"0": "O", "1": "I", "5": "S", "8": "B", "|": "I", "@": "A"}
DAMAGED_WORD = r"[A-Za-z][0-9][A-Za-z]|[0-9][A-Za-z]{2,}|[A-Za-z]{2,}[0-9](?![0-9])"
INDIC_ROLES = {"याचिकाकर्ता": "Petitioner", "प्रतिवादी": "Respondent", "प्रत्यर्थी": "Respondent", "वादी": "Plaintiff", "अपीलकर्ता": "Appellant", "अभियुक्त": "Accused"}
ROLE_MARKER = (
    r"[\.\u2026\-–—/:]{1,4}\s*(petitioner|respondent|plaintiff|defendant|appellant|applicant|claimant|complainant|accused|opposite\s+part(?:y|ies)|"
    r"deponent|obligor|obligee|financial\s+creditor|operational\s+creditor|corporate\s+debtor|corporate\s+applicant|decree\s+holder|judgment\s+debtor|"
    r"याचिकाकर्ता|प्रतिवादी|प्रत्यर्थी|वादी|अपीलकर्ता|अभियुक्त)s?"
)
CASE_TYPE_ROLES = {
    "wp": ("Petitioner", "Respondent"), "slp": ("Petitioner", "Respondent"), "cwp": ("Petitioner", "Respondent"), "crlmc": ("Petitioner", "Respondent"),
    "oa": ("Applicant", "Respondent"), "cs": ("Plaintiff", "Defendant"), "os": ("Plaintiff", "Defendant"), "comap": ("Appellant", "Respondent"),
    "ca": ("Appellant", "Respondent"), "fa": ("Appellant", "Respondent"), "sa": ("Appellant", "Respondent"), "crla": ("Appellant", "Respondent"),
    "omp": ("Claimant", "Respondent"), "arbp": ("Claimant", "Respondent"), "cp": ("Petitioner", "Respondent"), "ibc": ("Applicant", "Respondent"),
    "ma": ("Applicant", "Respondent"), "ia": ("Applicant", "Respondent"), "commercialsuit": ("Plaintiff", "Defendant"), "civilsuit": ("Plaintiff", "Defendant"),
    "suit": ("Plaintiff", "Defendant"), "civilappeal": ("Appellant", "Respondent"), "criminalappeal": ("Appellant", "Respondent"), "appeal": ("Appellant", "Respondent"),
    "writpetition": ("Petitioner", "Respondent"), "specialleavepetition": ("Petitioner", "Respondent"), "companypetition": ("Petitioner", "Respondent"),
    "arbitrationpetition": ("Claimant", "Respondent"), "executionpetition": ("Decree Holder", "Judgment Debtor"), "originalapplication": ("Applicant", "Respondent"),
    "petition": ("Petitioner", "Respondent"),
}

# How cases and forums are written.
FILED_NUMBER = r"\b([A-Z][A-Za-z.]{0,8}(?:\.[A-Z])?\.?\s*(?:\([A-Za-z]{1,3}\))?)\s*No\.?\s*(\d+)\s*(?:of|/)\s*(\d{4})\b"
FILED_WORDS = (
    r"\b((?:commercial\s+suit|civil\s+suit|civil\s+appeal|criminal\s+appeal|writ\s+petition|special\s+leave\s+petition|company\s+petition|"
    r"arbitration\s+petition|execution\s+petition|original\s+application|suit|appeal|petition))\s*(?:Nos?\.?)?\s*([\d\-–]*)\s*(?:of|/)\s*(\d{4})\b"
)
FILED_HEADING = (
    r"^\s*(?:[A-Z][A-Za-z.()\s]{0,40})?(?:suit|appeal|petition|application|slp|w\.?p\.?|c\.?a\.?|o\.?a\.?|crl)[A-Za-z.()\s]{0,12}"
    r"\s*Nos?\.?\s*[\d\-–,\s]*\s*(?:of|/)\s*\d{4}\s*$"
)
FILED_SHORT = (
    r"^\s*(?:bail\s+appln?|crl\.?\s*m\.?\s*c|crl\.?\s*a|w\.?\s*p|o\.?\s*m\.?\s*p|c\.?\s*p|c\.?\s*a|o\.?\s*a|i\.?\s*a|m\.?\s*a|s\.?\s*l\.?\s*p|arb)"
    r"[A-Za-z.()\s]{0,18}\s*(?:No\.?)?\s*\d+\s*/\s*[A-Za-z0-9/]+\s*$"
)
FILED_INDIC = r"(?:याचिका|वाद|अपील|मुकदमा)\s*(?:संख्या|सं\.?|क्रमांक)\s*\d+"
FORUM = (
    r"\b(?:in\s+the\s+)?(supreme\s+court|high\s+court|district\s+court|family\s+court|sessions\s+court|tribunal|arbitral\s+tribunal|nclt|nclat|drt|consumer\s+forum|magistrate)|"
    r"\b(?:this\s+(?:hon'?ble\s+)?commission|hon'?ble\s+commission)\b|(?:उच्च\s*न्यायालय|सर्वोच्च\s*न्यायालय|न्यायालय|अधिकरण)"
)

# Kinds of documents: their two roles, how parties are looked for, and patterns with weights. A versus line counts VERSUS_WEIGHT.
VERSUS_WEIGHT = 3.0
PROFILES = {
    "court_filing": (("Petitioner", "Respondent"), "cause_title", ((FILED_NUMBER, 3.0), (FORUM, 3.0), (ROLE_MARKER, 2.0))),
    "affidavit": (("Deponent", "—"), "deponent_clause", ((r"(?-i:\bI,\s+[A-Z])", 2.0), (r"\bdo\s+hereby\s+(?:solemnly\s+)?(?:affirm|state|declare)", 3.0), (r"\bverification\b", 1.0), (r"\bdeponent\b", 2.0))),
    "contract": (("First Party", "Second Party"), "recital", ((r"\bthis\s+agreement\s+is\s+made", 3.0), (r"(?s:\bbetween\b.{0,200}\band\b)", 1.0), (r"\bwhereas\b", 2.0), (r"\bwitnesseth\b|\bnow\s+therefore\b", 2.0), (r"\bin\s+witness\s+whereof\b", 2.0))),
    "legal_notice": (("Sender", "Recipient"), "letterhead", ((r"\blegal\s+notice\b", 3.0), (r"\bunder\s+instructions\s+from\s+my\s+client", 3.0), (r"\bmy\s+client\b", 1.0), (r"\bwithin\s+\d+\s+days\b", 1.0))),
    "correspondence": (("Sender", "Recipient"), "letterhead", ((r"(?m:^\s*(?:from|to)\s*:)", 2.0), (r"(?m:^\s*sub(?:ject)?\s*:)", 2.0), (r"(?m:^\s*ref(?:erence)?\s*(?:no\.?)?\s*:)", 1.5), (r"\b(?:dear\s+(?:sir|madam)|yours\s+(?:faithfully|sincerely|truly))\b", 2.0))),
    "financial": (("Account Holder", "Counterparty"), "statement_header", ((r"\b(?:a/?c|account)\s*(?:no\.?|number)", 3.0), (r"\bIFSC\b|\bMICR\b|\bUTR\b", 3.0), (r"(?s:\b(?:debit|credit)\b.{0,40}\b(?:balance)\b)", 2.0), (r"\b(?:invoice|tax\s+invoice|GSTIN)\b", 2.0))),
    "court_order": (("Petitioner", "Respondent"), "cause_title", ((r"\b(?:it\s+is\s+ordered|hereby\s+ordered|the\s+court\s+directs)\b", 3.0), (r"\bcoram\b|\bbefore\s+(?:hon|the\s+hon)", 3.0), (r"\b(?:oral\s+)?(?:order|judgment)\b", 1.0), (r"\blist\s+(?:on|after)\b", 1.0))),
    "generic": (("Party A", "Party B"), None, ()),
}
#: Words in lower case, one of which stands in whatever a detector matches, and what else does.
DETECTOR_WORDS = {
    FILED_NUMBER: ("no",),
    FORUM: ("court", "tribunal", "nclt", "nclat", "drt", "forum", "magistrate", "commission", "न्यायालय", "अधिकरण"),
    ROLE_MARKER: (
        "petitioner", "respondent", "plaintiff", "defendant", "appellant", "applicant", "claimant", "complainant", "accused", "opposite",
        "deponent", "obligor", "obligee", "creditor", "debtor", "holder", *INDIC_ROLES,
    ),
    r"(?-i:\bI,\s+[A-Z])": ("i,",),
    r"\bdo\s+hereby\s+(?:solemnly\s+)?(?:affirm|state|declare)": ("hereby",),
    r"\bverification\b": ("verification",),
    r"\bdeponent\b": ("deponent",),
    r"\bthis\s+agreement\s+is\s+made": ("agreement",),
    r"(?s:\bbetween\b.{0,200}\band\b)": ("between",),
    r"\bwhereas\b": ("whereas",),
    r"\bwitnesseth\b|\bnow\s+therefore\b": ("witnesseth", "therefore"),
    r"\bin\s+witness\s+whereof\b": ("whereof",),
    r"\blegal\s+notice\b": ("notice",),
    r"\bunder\s+instructions\s+from\s+my\s+client": ("client",),
    r"\bmy\s+client\b": ("client",),
    r"\bwithin\s+\d+\s+days\b": ("within",),
    r"(?m:^\s*(?:from|to)\s*:)": (":",),
    r"(?m:^\s*sub(?:ject)?\s*:)": (":",),
    r"(?m:^\s*ref(?:erence)?\s*(?:no\.?)?\s*:)": (":",),
    r"\b(?:dear\s+(?:sir|madam)|yours\s+(?:faithfully|sincerely|truly))\b": ("dear", "yours"),
    r"\b(?:a/?c|account)\s*(?:no\.?|number)": ("a/c", "ac"),
    r"\bIFSC\b|\bMICR\b|\bUTR\b": ("ifsc", "micr", "utr"),
    r"(?s:\b(?:debit|credit)\b.{0,40}\b(?:balance)\b)": ("balance",),
    r"\b(?:invoice|tax\s+invoice|GSTIN)\b": ("invoice", "gstin"),
    r"\b(?:it\s+is\s+ordered|hereby\s+ordered|the\s+court\s+directs)\b": ("ordered", "directs"),
    r"\bcoram\b|\bbefore\s+(?:hon|the\s+hon)": ("coram", "before"),
    r"\b(?:oral\s+)?(?:order|judgment)\b": ("order", "judgment"),
    r"\blist\s+(?:on|after)\b": ("list",),
}
DETECTOR_TAILS = {
    FILED_NUMBER: r"no\.?\s*\d+\s*(?:of|/)\s*\d{4}",
    r"(?-i:\bI,\s+[A-Z])": r"i,\s+[a-z]",
    r"(?m:^\s*(?:from|to)\s*:)": r"(?:from|to)\s*:",
    r"\b(?:a/?c|account)\s*(?:no\.?|number)": r"c(?:count)?\s*n",
    r"\bcoram\b|\bbefore\s+(?:hon|the\s+hon)": r"coram|hon",
}

# What is no name of a party.
CAPTION_LABEL = r"^(?:equivalent citations\b|author\s*:|bench\s*:|reportable\b|source:)|^(?:citation|citator info|date of judgment|act)\s*:?\s*$"
CAPTION_NAMES = (
    "citation", "citator info", "author", "bench", "equivalent citations", "reportable", "index", "synopsis", "list of dates", "list of dates and events",
    "paper book", "versus", "vakalatnama", "affidavit", "nature of matter", "land acquisition", "special category", "memo of parties", "written statement",
    "proforma for first listing",
)
BODY_OPENING = (
    r"^\s*(?:memo\s+of\s+parties|plaint\b|petition\s+under|application\s+under|written\s+statement|affidavit|synopsis|list\s+of\s+dates|index|paper\s*book|"
    r"counsel\s+for\s+petitioner|advocate-on-record|to,?\s*$|may\s+it\s+please|most\s+respectfully|the\s+humble\s+petition|\d+\s*[\.\)]\s*That\b|That\s+the\b|"
    r"(?:[JO])\s*[UR]\s*[DA]\s*[GE]\s*(?:M\s*E\s*N\s*T|R)\s*$|judgment\s*$|order\s*$|coram\b|with\s*$|and\s*$)"
)
BODY_VERBS = r"\b(?:filed|paid|issued|held|arise|arises|submitted|dismissed|granted|directed|passed)\b"
BODY_START = r"^(?:That\b|Leave\s+granted|The\s+\w+\s+(?:is|are|was|were|has|have|shall|may)\b)"
SENTENCE_START = r"^\s*(?:\d+\s*[\.\)]\s*)?(?:that\b|the\s+\w+\s+(?:is|are|has|have|was|were)\b)"
JUDGE_LINE = r"^\s*[A-Z][A-Za-z.\s]{2,40},\s*J\.?\s*[:\-]*\s*$"
FUNCTION_WORDS = r"\b(?:the|of|and|for|with|under|to|in)\b"
MONEY = r"(?:Rs\.?|₹|INR)\s?[\d,]"
NAME_LEAST, NAME_MOST, NAME_WORDS, NAME_FUNCTION_WORDS, BODY_LONG = 3, 90, 6, 3, 90
PARTY_DESCRIPTION = (
    r"^\s*(?:a\s+(?:company|firm|society|partnership)|having\s+its|registered\s+office|through\s+its|represented\s+by|r/?o\b|resident\s+of|aged\s+about|"
    r"s/?o\b|d/?o\b|w/?o\b|branch\b|office\s+at|indian\s+citizen|e-?mail\s*:|mobile\s*:|in\s+the\s+matter\s+of|section\s+\d+|read\s+with|\()"
)

# How parties are named outside a cause title, and how far it is looked for.
HEREINAFTER = r"\(\s*(?:herein\s*after|hereinafter)\s+(?:referred\s+to\s+as\s+|called\s+)?[\"'“”‘’]?(?:the\s+)?([A-Za-z][A-Za-z\s]{2,30}?)[\"'“”‘’]?\s*\)"
MY_CLIENT = r"(?:under\s+instructions\s+from|on\s+behalf\s+of|instructed\s+by)\s+(?:my|our)\s+client[s]?,?\s+([A-Z][^,\n.]{3,70})"
FROM_LINE = r"^\s*from\s*[,:]\s*(.+)$"
TO_LINE = r"^\s*to\s*[,:]?\s*$"
DEPONENT = r"\bI,\s*([A-Z][A-Za-z.\s]{2,60}?)\s*,\s*(?:s/?o|d/?o|w/?o|aged|r/?o|do\s+hereby|residing)"
INLINE_VERSUS = r"([A-Z][^\n\"']{2,70}?)\s+(?:versus|vs\.?|v/s|v\.)\s+([A-Z][^\n\"']{2,70}?)(?=\s*(?:[\"'\)]|$|,\s|\sis\b|\stitled\b|\sarising\b))"
RECITAL_LINES, RECITAL_REACH, RECITAL_BELOW, CLIENT_CHARS, LETTER_LINES, ADDRESSEE_LINES = 200, 30, 12, 4000, 120, 5
