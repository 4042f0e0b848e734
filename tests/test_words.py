"""Words of every script against brute force over Unicode names and categories."""

import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import retrieval
from cairn.plans import catalog
from cairn.plans.retrieval import LONGEST, STOP_WORDS

DENSE = ("CJK UNIFIED", "CJK COMPAT", "IDEOGRAPHIC ITERATION", "HIRAGANA LETTER", "KATAKANA LETTER", "KATAKANA-HIRAGANA PROLONGED", "THAI CHARACTER", "LAO ", "KHMER ", "MYANMAR ")
CASES = {
    "Prüft die WIEDZĄ, 2 mal!": ["prüft", "die", "wiedzą", "2", "mal"],
    "prüft": ["prüft"],
    "日本語。データー": ["日本", "本語", "デー", "ータ", "ター"],
    "字": ["字"],
    "गवाही दी": ["गवाही", "दी"],
    "قال الشاهد": ["قال", "الشاهد"],
    "ไทย ok": ["ไท", "ทย", "ok"],
    "v2データx": ["v2", "デー", "ータ", "x"],
    "☃️ --": [],
    "": [],
}


def brute(text):
    gone = X.DROPPED
    low = unicodedata.normalize("NFC", "".join(c for c in text if c not in gone)).lower()
    out, run, kind = [], "", None

    def end():
        out.extend([run[i : i + 2] for i in range(len(run) - 1)] if kind == "dense" and len(run) > 1 else [run] if run else [])

    for c in low:
        major = unicodedata.category(c)[0]
        sort = "dense" if major in "LM" and unicodedata.name(c, "").startswith(DENSE) else "plain" if major in "LN" or (major == "M" and kind == "plain") else None
        if sort != kind:
            end()
            run, kind = "", sort
        run += c if sort else ""
    end()
    return out


def test_cases(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t STRING")
    assert {r[0]: r[1] for r in df.select("t", X.words(df["t"])).collect()} == CASES
    assert all(brute(t) == w for t, w in CASES.items())
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(X.words(F.col("t"))).first()[0] is None


@pytest.fixture(scope="module")
def counted(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()
    return [(r[0], [w for w in brute(r[1]) if w not in STOP_WORDS and len(w) <= LONGEST]) for r in rows]


def test_postings_cover_all_scripts(spark, data, counted):
    occurrences, documents = Counter(w for _, ws in counted for w in ws), Counter(w for _, ws in counted for w in set(ws))
    got = {r["word"]: (r["occurrences"], r["documents"]) for r in catalog.QUERIES["text_x8_postings"](spark, data).collect()}
    assert got == {w: (n, documents[w]) for w, n in occurrences.items()}
    assert any(not w.isascii() for w in got)


def test_scores_by_brute_force(spark, data, counted):
    import math

    from cairn.plans.retrieval import TERMS

    held = Counter()
    for i, ws in counted:
        held[i] += len(ws)
    held = {i: n for i, n in held.items() if n}
    mean = sum(held.values()) / len(held)
    n = Counter((i, w) for i, ws in counted for w in ws)
    df = Counter(w for _, w in n)
    want = Counter()
    for (i, w), f in n.items():
        if w in TERMS:
            want[i] += math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * held[i] / mean))
    got = {r[0]: r[1] for r in catalog.QUERIES["text_x8_bm25"](spark, data).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)


def test_words_of_any_script_are_found(spark):
    docs = spark.createDataFrame([(1, "Er prüft es"), (2, "證據在此"), (3, "แมว")], "doc_id INT, text STRING")
    postings = docs.select("doc_id", F.explode(X.words(docs["text"])).alias("word")).groupBy("doc_id", "word").count().withColumnRenamed("count", "n")
    assert {r[0] for r in retrieval.bm25(postings, ["prüft", "證據", "แม"]).collect()} == {1, 2, 3}


def test_pieces_know_all_characters(spark, tmp_path):
    """Only a word beyond 100 characters is unknown, in whatever script the texts are."""
    texts = ["Prüft wiedzą, ok!", "證據在此。데이터", "गवाही दी", "قال ไทย 𝔞", "x" * 101, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["pieces"], r["unknown"]) for r in catalog.QUERIES["text_x3_pieces"](spark, str(tmp_path)).collect()}
    assert [got[i][1] for i in (0, 1, 2, 3, 4, 6)] == [0, 0, 0, 0, 1, 0] and got[4] == (1, 1) and got[6] == (0, 0)
