from collections import Counter

import pytest

from odd_rows import nothing, odd, ordered  # noqa: F401
from pointweave.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


def split(text):
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(docs, items, least=0.8):
    """Best similarity of every item-sized window, for pairs that reach ``least``."""
    out = {}
    for key, text in docs:
        w = split(text)
        for item, passage in items:
            q = split(passage)
            if not q or not w:
                continue
            n, want = min(len(q), len(w)), grams(q)
            shared = set(want)
            for s in range(len(w) - n + 1):
                if not (shared & set(grams(w[s : s + n]))):
                    continue
                got = grams(w[s : s + n])
                common = sum((got & want).values())
                sim = common / sum((got | want).values())
                if sim >= least:
                    out[key, item] = max(out.get((key, item), 0), 1000 * common // sum((got | want).values()))
    return out


def test_all_windows_within_reach(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.find_leaks(docs, items).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and want


def test_edits_ties_nulls_and_short_items(spark):
    base = " ".join(f"q{i}" for i in range(120))
    one = base.split()
    one[60] = "other"
    many = base.split()
    for i in range(10, 120, 10):
        many[i] = "other"
    items = [(1, base), (2, "two words"), (3, None), (4, "  \n "), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "two words"), (7, "A b C d e F g")]
    docs = [
        (1, "start of it " + base + " and on"), (2, " ".join(one)), (3, " ".join(many)), (4, "here two WORDS stand"), (5, None), (6, ""),
        (7, "x a b c d e f g y"), (7, "x a b c d e f g y"), (None, "a  b\tc\nd e f g"), (8, base + " " + base), (9, "a b c d"),
    ]
    rows = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    assert len(rows) == len(got)
    want = brute([d for d in docs if d[0] is not None], items)
    assert {k: v for k, v in got.items() if k[0] is not None} == want
    assert {k for k in got if k[0] is None} == {(None, 5), (None, 7)} and (3, 1) not in got


def test_blocks_find_every_pair_within_the_radius(spark):
    import random

    rng = random.Random(3)
    a = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(60)]
    b = [(i, v ^ sum(1 << x for x in rng.sample(range(63), rng.randrange(0, 12)))) for i, v in a]
    left, right = (dc.blocks(spark.createDataFrame(x, f"{n} long, fp long"), dc.RADIUS).withColumnRenamed("fp", f"fp_{n}") for x, n in ((a, "a"), (b, "b")))
    got = {(r["a"], r["b"]) for r in left.join(right, ["block", "bits"]).where(f"bit_count(fp_a ^ fp_b) <= {dc.RADIUS}").select("a", "b").distinct().collect()}
    want = {(i, j) for i, v in a for j, w in b if ((v ^ w) & ((1 << 64) - 1)).bit_count() <= dc.RADIUS}
    assert got == want


def test_fingerprint_is_the_majority(spark):
    texts = [(1, "a b c"), (2, "a"), (3, "a a b " * 50 + "z")]
    got = {r["tid"]: r["fp"] for r in dc.fingerprints(spark.createDataFrame(texts, "tid long, words string"), "tid").collect()}
    for tid, text in texts:
        words = text.split(" ")
        hashes = [r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) h").collect()]
        bits = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(words))
        assert got[tid] & ((1 << 64) - 1) == bits


def test_empty_and_clashing(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert dc.find_leaks(nothing, items).count() == 0
    assert dc.find_leaks(odd, items.where("1 = 0")).count() == 0
    assert {r["doc_id"] for r in dc.find_leaks(odd, items).collect()} == {8, 9}


@pytest.mark.parametrize("name", ["text_key", "id"])
def test_stage_keeps_columns(spark, odd, tmp_path, name):
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.withColumnRenamed("shard", name)
    kept = dc.drop_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 2


def test_edited_and_cut_passages_of_many_lengths(spark):
    """Tails and heads cut off, scattered edits, insertions and repeated words: nothing at 0.8 or above is lost."""
    import random

    rng = random.Random(11)
    filler = lambda n: [f"f{rng.randrange(3000)}" for _ in range(n)]
    items, docs = [], []
    for number in range(48):
        n = rng.choice([3, 5, 6, 9, 20, 25, 30, 40, 50, 60, 90, 150])
        vocabulary = rng.choice([4, 40, 4000])
        q = [f"v{rng.randrange(vocabulary)}" for _ in range(n)]
        items.append((None if number == 7 else number, " ".join(q)))
        for kind in range(6):
            w, cut = list(q), rng.randrange(0, 1 + max(1, n // 9))
            if kind == 0:
                w = w[: n - cut] + filler(cut)
            elif kind == 1:
                w = filler(cut) + w[cut:]
            elif kind == 2:
                for _ in range(rng.randrange(1, 4)):
                    w[rng.randrange(n)] = "edit"
            elif kind == 3:
                at = rng.randrange(n)
                w = w[:at] + filler(cut + 1) + w[at:]
            elif kind == 4:
                at = n // 2
                w = filler(cut // 2) + w[cut // 2 : at] + filler(cut + 1) + w[at : n - cut // 3]
            elif n - cut >= 5:
                w = w[: n - cut]  # the document ends with the cut
                docs.append((len(docs), " ".join(filler(0 if number % 2 else 30) + w)))
                continue
            docs.append((len(docs), " ".join(filler(rng.randrange(30)) + w + filler(rng.randrange(30)))))
    rows = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows} == want and len(rows) == len(want)
    assert sum(800 <= v < 900 for v in want.values()) > 40 and any(i is None for _, i in want)


def test_candidates_come_from_fingerprints(spark, monkeypatch):
    """Without a fingerprint within reach nothing is found, however many shingles a document shares; blocks with flips lose no pair."""
    import random

    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + " ".join(f"q{i}" for i in range(40)))], "doc_id long, text string")
    assert dc.find_leaks(docs, items).count() == 1
    monkeypatch.setattr(dc, "near_items", lambda windows, own: windows.crossJoin(own.select("iid")).select("tid", "iid").limit(0))
    assert dc.find_leaks(docs, items).count() == 0

    rng = random.Random(4)
    a = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(20)]
    b = [(i, v ^ sum(1 << x for x in rng.sample(range(63), 4 + i // 2 + 3))) for i, v in a]
    left = dc.blocks(spark.createDataFrame(a, "a long, fp long"), dc.RADIUS, dc.FLIPS).withColumnRenamed("fp", "fp_a")
    right = dc.blocks(spark.createDataFrame(b, "b long, fp long"), dc.RADIUS, dc.FLIPS, flip=True).withColumnRenamed("fp", "fp_b")
    got = {(r["a"], r["b"]) for r in left.join(right, ["block", "bits"]).where(f"bit_count(fp_a ^ fp_b) <= {dc.RADIUS}").select("a", "b").distinct().collect()}
    assert got == {(i, i) for i in range(20) if 7 + i // 2 <= dc.RADIUS}


def test_fingerprints_of_all_seeds_come_from_one_plan_and_are_written_before_they_meet(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "p q r s t u v w")], "tid long, words string")
    got = {(r["tid"], r["seed"]): r["fp"] for r in dc.fingerprints(rows, "tid", seeds=dc.SEEDS).collect()}
    for seed in range(dc.SEEDS):
        call = f"xxhash64({seed}, w)" if seed else "xxhash64(w)"
        for r in rows.selectExpr("tid", f"transform(split(words, ' '), w -> {call}) AS h").collect():
            fp = sum(1 << j for j in range(64) if 2 * sum((h >> j) & 1 for h in r["h"]) > len(r["h"]))
            assert got[r["tid"], seed] % (1 << 64) == fp
    assert len(got) == 3 * dc.SEEDS
    items = rows.where("tid <> 2").select(rows.tid.alias("iid"), "words").selectExpr("*", "5 AS unit")
    near = dc.near_items(rows.selectExpr("tid", "words", "5 AS unit"), items)
    assert {(1, 1), (3, 3)} <= {(r["tid"], r["iid"]) for r in near.collect()}
    # 32 sums and 64 bits for each seed and side stood in the plan of the join
    assert near._jdf.queryExecution().optimizedPlan().toString().count("sum(") == 0
