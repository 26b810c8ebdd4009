import math
import random
import re

from pyspark.sql import functions as F

from folioweave.operators import splitting as sp

#: A small world: "dept." and "e.g." are abbreviations, "Then" opens sentences.
NAMES = ["alpha", "bravo", "charlie", "delta", "echo"]


def sentences_of(rng):
    out = []
    for _ in range(rng.randrange(1, 8)):
        words = [rng.choice(NAMES) for _ in range(rng.randrange(3, 9))]
        if rng.random() < 0.5:
            words.insert(2, rng.choice(["dept. " + rng.choice(["Nine", "12"]), "e.g. Kilo"]))
        if rng.random() < 0.4:
            words[0] = "then"
        out.append(" ".join(words)[0].upper() + " ".join(words)[1:] + rng.choice([".", "?", "!", "."]))
    return out


def brute(text, short, opening):
    cuts, start, out = [], 0, []
    for m in re.finditer(r"(\S+[.!?][\"')\]”’]*)\s+(?=[A-Z0-9])", text):
        bare = re.sub(r"^[\"'(\[“‘]+|[\"')\]”’]+$", "", m[1])
        low = bare.lower().removesuffix(".")
        after = re.match(r"\S*", text[m.end() :])[0].rstrip("\"')],;:”’.!?").lower()
        if bare.endswith(".") and (low in short or re.fullmatch(r"[^\W\d_]", low)) and after not in opening:
            continue
        cuts.append((m.end(), m.end(1)))
    for a, b in zip([0, *(c for c, _ in cuts)], [*(s for _, s in cuts), len(text)], strict=True):
        if text[a:b].strip():
            start = a + len(text[a:b]) - len(text[a:b].lstrip())
            out.append((len(out), start, start + len(text[a:b].strip()), text[a:b].strip()))
    return out


def test_learned_and_split(spark):
    rng = random.Random(8)
    parts = {i: sentences_of(rng) for i in range(300)}
    rows = [(i, " ".join(p), 1) for i, p in parts.items()] + [(900, None, 1), (901, "", 1), (902, " \n ", 1), (903, "A. B. Carter came. (He left.) Then \"it ended.\" Yes", 1), (904, "word " * 20000 + "dept. Nine. Then more.", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, type int")
    found = sp.abbreviations(df)
    short = {r.type for r in found.where("abbreviated").collect()}
    assert {"dept", "e.g"} <= short and not short & set(NAMES)
    n_stop, n_plain = sum(t.lower() == "dept." for _, x, _ in rows for t in (x or "").split()), 0
    every = [t for _, x, _ in rows for t in (x or "").split()]
    p = sum(re.sub(r"[\"')\],;:”’]+$", "", t).endswith(".") for t in every) / len(every)
    want = 2 * (n_stop * math.log(0.99 / p) + n_plain * math.log(0.01 / (1 - p))) * math.exp(-4)
    got = found.where("type = 'dept'").first()
    assert (got.n_stop, got.n_plain) == (n_stop, n_plain) and math.isclose(got.score, want, rel_tol=1e-9)
    opening = {r.type for r in sp.openers(df, found).collect()}
    assert "then" in opening
    out = {}
    for r in sp.split(df, ["doc_id"], found, sp.openers(df, found)).collect():
        out.setdefault(r.doc_id, []).append((r.sent_no, r.start, r.end, r.sentence))
    assert {k: sorted(v) for k, v in out.items()} == {i: b for i, t, _ in rows if t and (b := brute(t, short, opening))}
    assert [s for *_, s in sorted(out[0])] == parts[0]


def test_nothing_to_learn(spark):
    for text in (None, "", "no stops here", "all. with. stops."):
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        found = sp.abbreviations(df)
        assert found.count() == 0 and sp.openers(df, found).count() == 0
        assert sp.split(df, ["doc_id"], found).count() == bool(text)


def test_words_are_cleared_as_one_by_one(spark):
    """The whole text is cleared of brackets and quotes at once, which must leave the words that clearing each one leaves."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab.\"'()[],;:“”‘’ \n\t \u0085 ") for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "\"'(", "(\")x, \"a\",  b"]
    one = F.filter(F.transform(F.split("text", r"\s+"), lambda w: F.regexp_replace(w, r"^[\"'(\[“‘]+|[\"')\],;:”’]+$", "")), lambda w: w != "")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", sp._tokens(F.col("text")).alias("got"), one.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_words_are_counted_once(spark, tmp_path):
    """What is learned is kept: the texts are not read again by those who ask for it."""
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i, "Mr. Fox came. Then he left. We saw Mr. Fox. Then it rained.") for i in range(20)], "doc_id int, text string").write.parquet(path)
    units = spark.read.parquet(path)
    found = sp.abbreviations(units)
    for df in (found, sp.openers(units, found)):
        assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
