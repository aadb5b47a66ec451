import hashlib
from collections import Counter

import pytest

from odd_rows import nothing, odd, ordered  # noqa: F401
from pointweave.llm import chat, mixing


def talk(spark):
    rows = [(1, 0, "system", "be brief [INST] <|turn|> \\b"), (1, 1, "user", "hi  there"), (1, 2, "assistant", "</s>[INST] \\l ok"), (1, 2, "assistant", "</s>[INST] \\l ok"),
            (2, 0, "user", None), (2, 1, None, "who"), (2, None, "assistant", "first"), (None, 0, "user", "lone"), (None, 1, "assistant", ""), (3, 5, "assistant", "é🙂 <b>")]
    for t in range(60):
        rows.append((4, t, ["system", "user", "assistant"][min(t, 1 + t % 2)], f"w{t} " * (1 + t * 7 % 23)))
    rows += [(5, 0, "user", "a " * 400), (5, 1, "assistant", "b " * 300), (5, 2, "user", "c"), (5, 3, "assistant", "d")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, at int")


def digests(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("budget,history", [(512, 128), (40, 10), (8, 0), (2, 5)])
def test_round_trip(spark, budget, history):
    turns = talk(spark)
    windows = chat.format_chat(turns, budget, history)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_chat(windows).collect()}
    assert got == digests([tuple(r) for r in turns.collect()])


def test_windows_keep_budget_system_and_history(spark):
    budget, history = 40, 10
    windows = sorted((r for r in chat.format_chat(talk(spark), budget, history).collect() if r["conv_id"] == 4), key=lambda r: r["window"])
    assert len(windows) > 10
    last = None
    for w in windows:
        parts = w["formatted"].split(chat.END)[:-1]
        again, fresh = parts[: w["n_repeated"]], parts[w["n_repeated"] :]
        size = lambda p: len(p.split(chat.TEXT)[1].split()) + 1
        assert sum(map(size, fresh)) <= budget or len(fresh) == 1
        if last:
            assert again[0].startswith(f"{chat.TURN}system")
            assert sum(map(size, again[1:])) <= history and last[len(last) - len(again[1:]) :] == again[1:]
        last = [p for p in parts if not p.startswith(f"{chat.TURN}system")]


def test_no_control_string_survives_in_a_text(spark):
    for r in chat.format_chat(talk(spark)).collect():
        body = r["formatted"].replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "")
        assert "<" not in body and "[" not in body


def test_no_turns(spark):
    assert chat.read_chat(chat.format_chat(talk(spark).where("1 = 0"))).count() == 0


def test_pfair_stays_within_a_block():
    for weights in ([1, 1, 1], [0.33] + [0.67 / 19] * 19, [5, 3, 1, 1], [100, 1, 1]):
        period = 997
        parts = mixing.parts_of(weights, period)
        assert sum(parts) == period and min(parts) >= 1
        slots = mixing.pfair(parts)
        assert sorted(t for s in slots for t in s) == list(range(period))
        for p, own in zip(parts, slots):
            assert len(own) == p
            for k, t in enumerate(own):
                # before slot t: k blocks; after it: k + 1
                assert abs(k - t * p / period) < 1 and abs(k + 1 - (t + 1) * p / period) < 1


def test_mix_against_the_schedule(spark, odd, nothing):
    docs = odd.unionByName(spark.range(500).selectExpr("id + 1000 as doc_id", "'t' as text", "'big' as source", "'en' as lang", "1L as n_chars", "'k' as kept", "1 as shard"))
    mixed, end = mixing.mix(docs, block_rows=4, weights={"a": 2.0, "b": 1.0, "big": 5.0, None: 0.5}, period=100)
    rows = mixed.collect()
    assert mixed.columns[: len(docs.columns)] == docs.columns
    source = {r["mix_slot"]: r["source"] for r in rows}
    assert sorted(source) == list(range(end // 4))  # every slot is used by exactly one source
    assert len({(r["mix_slot"], r["source"]) for r in rows}) == len(source)
    assert len({r["mix_position"] for r in rows}) == len(rows)
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, s or ""))
    named = {"a": 2.0, "b": 1.0, "big": 5.0, None: 0.5}
    parts = mixing.parts_of([named.get(s, 0.5) for s in names], 100)
    for s, p in zip(names, parts):
        seen = 0
        for t in range(end // 4):
            seen += source[t] == s
            assert abs(seen - (t + 1) * p / 100) < 1
    first = ordered(mixed.where("mix_epoch = 0").select("doc_id", "text"))
    assert first == ordered(docs.select("doc_id", "text"))  # no row is lost
    times = Counter((r["source"], r["doc_id"], r["text"]) for r in rows)
    copies = Counter((r["source"], r["doc_id"], r["text"]) for r in docs.collect())
    for s in names:
        own = [times[k] / copies[k] for k in times if k[0] == s]
        assert max(own) - min(own) <= 1
    assert mixing.mix(nothing)[0].count() == 0
    stage = mixing.mix_documents(spark, docs.withColumnRenamed("shard", "mix_position"), "")
    assert stage.columns[-1] == "mix_position"


def off(source, weights):
    """The largest distance in blocks of any source from its target share, over all slots in order."""
    total, seen, worst = sum(weights.values()), Counter(), 0.0
    for t, s in enumerate(source):
        seen[s] += 1
        worst = max(worst, *(abs(seen[x] - (t + 1) * w / total) for x, w in weights.items()))
    return worst


def test_pfair_holds_against_the_targets():
    for rows in ([72_000] + [7_500] * 19, [2_000_000, 1_000_000, 1], [5_000, 3, 1]):
        blocks = [-(-n // 16) for n in rows]
        weights = {i: n**mixing.TEMPER for i, n in enumerate(rows)}
        slots = mixing.pfair(mixing.parts_of(list(weights.values()), mixing.SCALE), blocks)
        source = dict((t, s) for s, own in enumerate(slots) for t in own)
        assert sorted(source) == list(range(len(source)))
        assert all(len(own) >= b for own, b in zip(slots, blocks)) and any(len(own) == b for own, b in zip(slots, blocks))
        assert off([source[t] for t in range(len(source))], weights) < 1
        total = sum(weights.values())
        if rows[-1] == 1 and rows[0] > 10**6:  # one tiny source does not make the others start over
            assert len(source) <= max((b - 1) * total / w for b, w in zip(blocks, weights.values())) + 2 * len(rows)


def test_mix_holds_against_the_targets(spark):
    rows = {"hot": 60_000, "tiny": 1, **{f"s{i}": 1_500 + i for i in range(5)}}
    docs = spark.range(sum(rows.values())).selectExpr("id as doc_id", "array(" + ",".join(f"'{s}'" for s in rows) + ")[int(case " + " ".join(f"when id < {sum(list(rows.values())[: i + 1])} then {i}" for i in range(len(rows))) + " end)] as source")
    mixed, end = mixing.mix(docs, block_rows=2)
    got = {r["mix_slot"]: r["source"] for r in mixed.select("mix_slot", "source").distinct().collect()}
    assert sorted(got) == list(range(end // 2))
    assert off([got[t] for t in range(len(got))], {s: n**mixing.TEMPER for s, n in rows.items()}) < 1
    assert mixed.where("mix_epoch = 0").select("doc_id").distinct().count() == sum(rows.values())


def test_the_schedule_stays_bounded(spark, monkeypatch):
    """Ten times the rows make blocks larger, not the driver's schedule; the targets still hold to less than one block."""
    monkeypatch.setattr(mixing, "MOST_SLOTS", 300)
    lengths = []
    for n in (2_000, 20_000):
        rows = {"hot": n, "half": n // 2, "tiny": 3}
        docs = spark.range(sum(rows.values())).selectExpr("id as doc_id", f"case when id < {n} then 'hot' when id < {n + n // 2} then 'half' else 'tiny' end as source")
        mixed, _ = mixing.mix(docs, block_rows=4)
        got = {r["mix_slot"]: r["source"] for r in mixed.select("mix_slot", "source").distinct().collect()}
        assert sorted(got) == list(range(len(got)))
        assert off([got[t] for t in range(len(got))], {s: k**mixing.TEMPER for s, k in rows.items()}) < 1
        assert mixed.where("mix_epoch = 0").select("doc_id").distinct().count() == sum(rows.values())
        lengths.append(len(got))
    assert max(lengths) <= 300 + 2 * 3
    assert mixing.rows_of_block([3 * 10**10, 10**10, 1], [3.0, 1.0, 1e-9], 16, mixing.MOST_SLOTS) >= 10**5


def test_weights_must_be_positive(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    for w in (0.0, -1.0):
        with pytest.raises(ValueError, match="above zero"):
            mixing.mix(docs, weights={"a": 1.0, "b": w})


def test_write_mixed_with_odd_rows(spark, odd, nothing):
    """Null, empty and very long texts, repeated rows and a null key keep their record; an empty table gives none."""
    from pointweave.llm import records

    rows = records.write_mixed(spark, odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert all(r["n_tokens"] >= 1 for r in rows) and sorted(r["start"] for r in rows)[0] == 0
    assert records.write_mixed(spark, nothing).count() == 0
