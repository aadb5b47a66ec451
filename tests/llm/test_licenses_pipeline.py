import re

import pytest

from odd_rows import nothing, odd  # noqa: F401
from pointweave.llm import licenses as li
from pointweave.llm import quality
from pointweave.llm.license_texts import PHRASES, TEMPLATES

SF = "/root/testdata/sf0.001"


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = words(text)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = ["The MIT License; mit license. Apache-License", "GNU General\n Public license CC BY-SA cc  by", "cc by cc by", "mıt license", "İmit license"]


def test_base_against_brute_force(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted([tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in li.scan_licenses(docs)[0].collect()], key=key)
    want = sorted([(r["doc_id"], *base(r["text"])) for r in docs.collect()], key=key)
    assert got == want


def test_spans_survive_cuts_and_insertions(spark):
    mit = TEMPLATES["mit-text"].split()
    cut = mit[:60] + mit[63:]
    grown = mit[:80] + ["inserted", "words"] + mit[80:]
    few = mit[:20]
    apart = mit[:50] + ["x"] * 300 + mit[50:75]
    docs = [(1, "intro " * 30 + " ".join(cut)), (2, " ".join(grown)), (3, " ".join(few)), (4, " ".join(apart)), (5, " ".join(mit) + " gap " * 50 + " ".join(mit))]
    every, spans = li.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in every.collect()}
    assert [got[i]["labels"] for i in range(1, 6)] == ["mit-text", "mit-text", "", "", "mit-text"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["score"] > 0.9
    s = sorted([(r["doc_id"], r["first_word"], r["last_word"]) for r in spans.collect()])
    n = len(words(" ".join(mit)))
    assert [x[0] for x in s] == [1, 2, 5, 5] and s[0][1] == 30 and s[1][1:] == (0, n + 1) and s[3][1] == n + 50


def covered(text, label):
    """Share of the template's 4-grams that stand in the text."""
    grams = lambda w: [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
    there = set(grams(words(text)))
    return sum(g in there for g in grams(words(TEMPLATES[label]))) / len(grams(words(TEMPLATES[label])))


@pytest.mark.parametrize("label", ["mit-text", "bsd-3-clause-text", "isc-text"])
def test_parts_of_a_template_are_joined(spark, label):
    text = TEMPLATES[label].split()
    n = len(text)
    put = lambda at, count: " ".join(text[:at] + [f"added{i}" for i in range(count)] + text[at:])
    twice = text[: n // 3] + ["one"] * 30 + text[n // 3 : 2 * n // 3] + ["two"] * 30 + text[2 * n // 3 :]
    docs = [put(at, count) for count in (5, 20, 50) for at in (n // 3, n // 2, 2 * n // 3)] + [" ".join(twice)]
    docs += [" ".join(text[: n // 2] + text[n // 2 + 12 :])]
    below = [" ".join(text[: n // 3]), " ".join(text[n // 2 :] + text[: n // 2]), put(n // 2, 200)]
    every, spans = li.scan_licenses(spark.createDataFrame(list(enumerate(docs + below)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in every.collect()}
    span = {r["doc_id"]: r for r in spans.where(f"label = '{label}'").collect()}
    for i, doc in enumerate(docs):
        assert label in got[i]["labels"].split(","), (i, got[i])
        # a wording that the template repeats counts for its cut place in the brute force, too
        assert span[i]["coverage"] == pytest.approx(covered(doc, label), abs=0.02 if i == len(docs) - 1 else 1e-9)
        assert (span[i]["first_word"], span[i]["last_word"]) == (0, len(words(doc)) - 1)
    for i, doc in enumerate(below, len(docs)):
        assert label not in got[i]["labels"].split(",") and i not in span
    assert got[len(docs)]["score"] == pytest.approx(covered(below[0], label))
    assert 0.4 < got[len(docs) + 1]["score"] < 0.6 and 0.4 < got[len(docs) + 2]["score"] < 0.6


def test_hash_collisions_do_not_vote(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(li.F, "xxhash64", lambda *c: F.length(F.concat_ws("", *c)).cast("long"))
    docs = [(1, "mere prose of other words " * 40), (2, TEMPLATES["isc-text"])]
    got = {r["doc_id"]: r["labels"] for r in li.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"))[0].collect()}
    assert got == {1: "", 2: "isc-text"}


def test_empty(nothing):
    every, spans = li.scan_licenses(nothing)
    assert every.count() == 0 and spans.count() == 0


@pytest.fixture(scope="module")
def staged(spark):
    """Every stage's input and output on the smallest tables."""
    import corpus_pipeline
    from pointweave.llm.common import materialise, table

    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "stage")
        seen.append((name, docs, out))
        docs = out
    return seen


def test_stages_against_brute_force(spark, staged):
    from test_decontaminate import brute as leaks
    from test_ngram_join import brute as near
    from test_records_tokens import WORDS
    from tokenizers import Tokenizer

    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    (_, docs, good), (_, _, one), (_, _, clean), (_, _, mixed), (_, _, last) = staged
    assert all(out.columns == docs.columns for _, _, out in staged[:-1])
    parts = near(rows(good), 5, 80)
    assert sorted(i for i, _ in rows(one)) == sorted({c for _, _, c in parts})
    items = rows(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    bad = {i for i, _ in leaks(rows(one), items)}
    assert sorted(i for i, _ in rows(clean)) == sorted(i for i, _ in rows(one) if i not in bad)
    assert {i for i, _ in rows(mixed)} == {i for i, _ in rows(clean)}
    lib = Tokenizer.from_file(WORDS)
    want = sorted((i, len(lib.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows(mixed))
    got = sorted((r["doc_id"], r["n_tokens"]) for r in last.collect())
    assert got == want


def test_clean_documents_stay(spark, staged):
    """Of the documents labelled clean only those go that the base rule must reject: too few words, or too many repeated."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    (_, docs, good) = staged[0]
    allowed = quality.quality_rules(docs).where("not base_failed").join(labels, "doc_id").count()
    assert 0 < allowed == good.join(labels, "doc_id").count()


def test_token_files_keep_the_mixed_order(spark, staged, tmp_path):
    from pointweave.llm import mixing, records

    mixed, last = staged[3][2], staged[4][2]
    at = mixed.selectExpr("doc_id", "source", "_metadata.file_name as f", "_metadata.row_index as r").orderBy("f", "r").collect()
    got = [r["doc_id"] for r in last.orderBy("start").collect()]
    assert got == [r["doc_id"] for r in at] and got != sorted(got)
    again, _ = mixing.mix(staged[3][1])
    want = [(r["doc_id"], r["source"]) for r in again.orderBy("mix_position").select("doc_id", "source").collect()]
    assert [(r["doc_id"], r["source"]) for r in at] == want  # sources take turns as scheduled
    # a table that is not read from files keeps the order of its rows
    docs = spark.createDataFrame([(i, f"t {i}") for i in (5, 3, 9, 1, 7, 3)], "doc_id long, text string")
    out = records.write_mixed(spark, docs).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [5, 3, 9, 1, 7, 3]
