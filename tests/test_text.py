import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import quality
from tessera.functions import text as X
from tessera.functions.mdformat import format_markdown
from tessera.functions.porter import porter
from tessera.functions.redact import MARK, checked_rules, redact
from tessera.operators import lexical


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("word, stem", [("connecting", "connect"), ("running", "runn"), ("sing", "sing"), ("nationality", "national"), ("cats", "cats"), ("tables", "tabl"), ("Happily", "happi")])
def test_stem(spark, word, stem):
    assert one(spark, word.lower(), X.stem) == stem


def test_scalars(spark):
    assert one(spark, "aabb", X.entropy) == pytest.approx(1.0)
    assert one(spark, "", X.entropy) == 0.0
    assert one(spark, "a b a b", X.ttr) == 0.5
    assert one(spark, "a b c a b c", lambda c: X.duplicate_ratio(c, 3)) == pytest.approx(1 - 3 / 4)
    assert one(spark, "a b", lambda c: X.duplicate_ratio(c, 3)) == 0.0
    assert one(spark, "!!", X.symbol_ratio) == 1.0
    assert one(spark, " Ab \n", X.content_hash) == one(spark, "ab", X.content_hash)
    assert one(spark, "# Head\none\ntwo", X.title) == "Head"
    assert one(spark, "# Head\none\ntwo\nthree\nfour", X.snippet) == "one two three"
    assert one(spark, "x" * 70, X.title) == "x" * 57 + "..."
    assert one(spark, "#Foo_Bar-baz x", X.tag_key) == "foobarbazx"
    assert one(spark, "see `code` at https://x.y/z and a/b.py now", X.prose) == "see at and now"
    assert one(spark, "id 123e4567-e89b-12d3-a456-426614174000 end", X.uuid_in) == "123e4567-e89b-12d3-a456-426614174000"


def test_redaction(spark):
    assert MARK in one(spark, "key ghp_" + "a1" * 18, redact)
    assert one(spark, "nothing here", redact) == "nothing here"
    assert one(spark, "Code: zz-77", lambda c: redact(c, checked_rules(spark, ["# no", "", "(", r"zz-\d+"])[0])) == f"Code: {MARK}"


def test_markdown_format_is_idempotent():
    text = "# T  \r\n\r\n\r\n\r\n```\ndef f():\n    pass\n``` \nend\n```\nopen"
    once = format_markdown(text)
    assert once.startswith("# T\n\n```python") and format_markdown(once) == once and once.endswith("```\nopen")
    assert format_markdown(None) == ""


GOOD = "# Setup\n\n- install the tool from src/main.py\n- run the build_step of the app\n\n```python\nprint(1)\n```\n"


@pytest.mark.parametrize(
    "text, status, flag",
    [
        ("short", "REJECT", "SHORT_LENGTH"), ("word " * 60, "REJECT", "LOW_ENTROPY"), ("a" * 30 + " |x|\n|y|", "REJECT", "HIGH_SYMBOL_RATIO" if False else "BROKEN_MARKDOWN_SYNTAX"), ("text enough for the gate\n```\nopen block here", "REJECT", "BROKEN_MARKDOWN_SYNTAX"),
        (GOOD, "ACCEPT", "HAS_CODE"), (None, "REJECT", "SHORT_LENGTH"), ("got it" + " " * 30, "REJECT", "SHORT_LENGTH"),
    ],
)
def test_gate(spark, text, status, flag):
    r = quality.gate(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r["quality_status"] == status and flag in r["quality_flags"], r


def test_query_terms():
    assert lexical.query_terms('the "quick fox') == ["quick", "fox"]
    assert lexical.query_terms("the of") == ["the", "of"]
    assert lexical.query_terms("a+b (c*) --") == ["b", "c"] or lexical.query_terms("a+b (c*) --") == ["b", "c"]


def test_bm25_and_stems_equal_sqlite(spark):
    texts = ["connecting the machines", "connections were lost and found", "a machine connected machines", "nothing of note", "relational hopping agreed"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='porter')")
    db.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(texts)))
    want = dict(db.execute("select rowid, -bm25(f) from f where f match 'connect OR machine'").fetchall())
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    posts = lexical.postings(docs, "id", {"t": F.col("t")}, stemmed=True)
    got = {r["id"]: r["score"] for r in lexical.bm25(posts, lexical.lengths(posts, docs, "id"), ["connect", "machin"], prefix=False).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-5)


def test_porter_equals_sqlite():
    words = re.findall("[a-z]+", "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective bowdlerize probate rate cease controll roll")
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='porter')")
    db.execute("create virtual table v using fts5vocab(f, 'instance')")
    db.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(words, 1)))
    want = {words[d - 1]: t for t, d in db.execute("select term, doc from v")}
    assert {w: porter(w) for w in words} == want


def test_measures_know_words_edges_and_spaces_as_python_does(spark):
    """Texts of the characters that matter, measured by Python's own patterns."""
    rng = random.Random(5)
    bits = ["a", "b1", "Foo", "x_y", "AB", "é", "ß", "日", "٣", "-", "--", "/", ".", ".py", ".md", "`", "```", "!", " ", " ", "\n", "\u00a0", "\u3000", "\x1f", "http://", "the", "of", "word", "…"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)] + ["ends here. Next", "- one -two three- --four", "see /etc/foo.py/bar.md", "--x/foo.py", "a.b", "foo.é", "café-bar"]
    paths, idents = "py|rs|js|ts|json|md|sql|yml|yaml|c|cpp|h|sh|db", "py|js|ts|json|md|rs|go|c|cpp|h|yml|yaml|sql|sh|db"

    def prose(t):
        for p in (r"```[\s\S]*?```", r"`[^`\n]+`", r"https?://\S+", rf"\b[\w/-]+\.(?:{paths})\b", r"\s+"):
            t = re.sub(p, " ", t)
        return t.strip()

    def cli(p):
        w = re.findall(r"\b[a-zA-Z0-9_-]+\b", p)
        n = max(1, sum(bool(x.strip()) for x in re.split(r"[.!?]+", p)))
        return 0.0588 * (sum(map(len, w)) / len(w) * 100) - 0.296 * (n / len(w) * 100) - 15.8 if w else 0.0

    def specificity(t):
        n = len(re.findall(r"\w+", t))
        return len(re.findall(rf"\b[a-z0-9_]+[A-Z0-9_.][a-zA-Z0-9_]*\b|\b[A-Z0-9_]{{2,}}\b|\b\w+\.(?:{idents})\b", t)) / n if n else 0.0

    def symbols(t):
        a = sum(c.isalnum() for c in t)
        return sum(not c.isalnum() and not c.isspace() for c in t) / a if a else float(t != "")

    def content(t):
        w = {x for x in re.findall(r"\b[a-zA-Z0-9_-]{3,}\b", t.lower()) if x not in X.STOP_WORDS}
        return sorted({next((x[: -len(e)] for e in X.SUFFIXES if x.endswith(e) and len(x) > len(e) + 3), x) for x in w})

    def marks(t):
        return bool(re.search(r"\b[\w/-]+\.(?:py|rs|js|ts|json|md|sql|yml|yaml|c|cpp|h|sh)\b|\b[a-z0-9_]+_[a-z0-9_]+\b", t))

    t, df = F.col("t"), spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", X.prose(t).alias("p"), X.specificity(t).alias("s"), X.symbol_ratio(t).alias("y"), X.content_tokens(t).alias("c"), t.rlike(quality.IDENTIFIERS).alias("i"), X.strip(t).alias("z"))
    for r in got.withColumn("l", X.coleman_liau(F.col("p"))).collect():
        x = r["t"]
        assert (r["p"], r["c"], r["i"], r["z"]) == (prose(x), content(x), marks(x), x.strip()), x
        assert r["s"] == pytest.approx(specificity(x)) and r["y"] == pytest.approx(symbols(x)) and r["l"] == pytest.approx(cli(prose(x)), abs=0.0051), x


def test_measures_of_long_texts_take_one_pass():
    from time import process_time

    from tessera.functions import measures

    t = "Plain words of a text, some of them long_ones, and src/a.py too. " * 2000
    began = process_time()
    m, p = measures.of_words(t), measures.of_prose(measures.prose(t, X.PATH), frozenset(X.FUNCTION_WORDS), frozenset())
    assert process_time() - began < 1.0  # 130,000 characters
    assert m["n"] == m["n_lower"] == 28000 and m["spec"] == pytest.approx(2 / 14) and m["ttr"] == pytest.approx(12 / 28000) and p["n"] == 22000
    assert m["sym"] == pytest.approx(measures.symbol_ratio(t)) and p["cli"] == measures.coleman_liau(measures.prose(t, X.PATH))


@pytest.mark.parametrize("key", ["ghp_" + "a1" * 18, "AKIA" + "Q7" * 8, "sk-proj-" + "b" * 20, "c" * 20 + ":" + "d" * 40, "M" + "e" * 23 + "." + "f" * 6 + "." + "g" * 27])
def test_redaction_behind_other_runs(spark, key):
    assert one(spark, f"x-{key}, {'y' * 30} ({key})é_{key} {key[:-1]}", redact).count(MARK) >= 2
    assert one(spark, "z" + key, redact) == ("z" + key if ":" not in key else MARK)
