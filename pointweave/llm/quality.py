"""Quality rules as a short-circuit cascade (operator 1).

Every text gets its base statistics. The rules of the verdict then run one after another, each only on the documents
that no earlier rule has rejected. Their order comes from a bounded sample: each rule's seconds per document and its
share of rejections are measured, and rules run by rejections per second, best first. The order changes only the time;
a document is kept when no rule rejects it, whatever the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, codes, combine, slices, table, texts, words
from .registry import llm_query

SAMPLE_ROWS = 400
SAMPLE_TEXT_BYTES = 65_536
WINDOW = 5
#: Words over which distinct ones are counted: their share in a whole text falls with its length.
STRETCH = 1000
SYMBOLS = b"#*$%&|<>"


@dataclass
class Slice:
    """The texts of a slice, with statistics made once on first use."""

    text: pa.Array
    _made: dict = field(default_factory=dict)

    def get(self, name: str):
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def only(self, chosen: np.ndarray) -> Slice:
        """The chosen texts, with what is already known of them."""
        part = Slice(self.text.take(pa.array(chosen)))
        for name, value in self._made.items():
            if isinstance(value, np.ndarray) and len(value) == len(self.text) and name != "blank":
                part._made[name] = value[chosen]
        if "words" in self._made:
            offsets, index, distinct = self._made["words"]
            counts = np.diff(offsets)
            taken = np.zeros(len(counts), bool)
            taken[chosen] = True
            part._made["words"] = np.concatenate([[0], np.cumsum(counts[chosen])]), index[np.repeat(taken, counts)], distinct
        return part

    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        whole = pa.concat_arrays([self.text.cast(pa.large_binary())])
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        return data, offsets - offsets[0]

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        _, offsets = self.get("bytes")
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def _blank(self) -> np.ndarray:
        data, _ = self.get("bytes")
        return (data == 32) | ((data >= 9) & (data <= 13))

    def _word_chars(self) -> np.ndarray:
        data, _ = self.get("bytes")
        return self.per_text(((data & 0xC0) != 0x80) & ~self.get("blank"))

    def _n_symbols(self) -> np.ndarray:
        data, _ = self.get("bytes")
        wanted = np.zeros(256, bool)
        wanted[list(SYMBOLS)] = True
        return self.per_text(wanted[data])

    def _words(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        offsets, flat = words(self.text)
        index, distinct = codes(flat)
        return offsets, index, distinct

    def _n_words(self) -> np.ndarray:
        return np.diff(self.get("words")[0])

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, line code) of every line with a word; equal codes mean equal lines."""
        lists = pc.split_pattern(self.text, "\n")
        flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(self.text)), counts)
        index, distinct = codes(flat)
        full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(distinct)), 0).to_numpy(zero_copy_only=False)
        keep = full[index] if len(index) else np.zeros(0, bool)
        return owner[keep], index[keep]

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.get("lines")[0], minlength=len(self.text))

    def _n_dup_lines(self) -> np.ndarray:
        owner, line = self.get("lines")
        pairs = owner * (line.max(initial=0) + 1) + line
        first = np.unique(pairs, return_index=True)[1]
        return self.get("n_lines") - np.bincount(owner[first], minlength=len(self.text))

    def _n_repeat_words(self) -> np.ndarray:
        """Words inside a window of five that occurs twice or more in its text; windows are compared word by word."""
        offsets, index, _ = self.get("words")
        out = np.zeros(len(self.text), np.int64)
        n = len(index)
        if n < WINDOW:
            return out
        rolled = combine([index[i : n - WINDOW + 1 + i].astype(np.uint64) for i in range(WINDOW)])
        for t in np.flatnonzero(np.diff(offsets) > WINDOW):
            a, b = offsets[t], offsets[t + 1]
            h = rolled[a : b - WINDOW + 1]
            order = np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
            if not same.any():
                continue
            x, y = order[1:][same], order[:-1][same]
            w = index[a:b]
            equal = np.ones(len(x), bool)
            for i in range(WINDOW):
                equal &= w[x + i] == w[y + i]
            if not equal.all():
                out[t] = _repeats_exact(w)
                continue
            cover = np.zeros(b - a + 1, np.int64)
            starts = np.unique(np.concatenate([x, y]))
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            out[t] = int((np.cumsum(cover)[:-1] > 0).sum())
        return out

    def _letters(self) -> np.ndarray:
        """Per text: letters a-z, A-Z and every code point beyond ASCII."""
        data, _ = self.get("bytes")
        low = data | 0x20
        return self.per_text(((low >= 97) & (low <= 122)) | (data >= 0xC0))

    def _near_distinct_words(self) -> np.ndarray:
        """Distinct words in each stretch of ``STRETCH`` words, added up."""
        offsets, index, distinct = self.get("words")
        owner = np.repeat(np.arange(len(self.text)), np.diff(offsets))
        pieces = -(-np.diff(offsets) // STRETCH)
        piece = (np.cumsum(pieces) - pieces)[owner] + (np.arange(len(index)) - offsets[owner]) // STRETCH
        first = np.unique(piece * (len(distinct) + 1) + index, return_index=True)[1]
        return np.bincount(owner[first], minlength=len(self.text))

    def _stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        offsets, index, _ = self.get("words")
        same = np.zeros(len(index) + 1, bool)
        same[1:-1] = index[1:] == index[:-1]
        same[offsets[:-1]] = False
        total = np.concatenate([[0], np.cumsum(same)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def _marked_words(self) -> np.ndarray:
        """Words whose last character is one of ``!`` or a symbol."""
        offsets, index, distinct = self.get("words")
        if not len(distinct):
            return np.zeros(len(self.text), np.int64)
        odd = pc.match_substring_regex(distinct, r"[!#*$%&|<>]{2,}$|^[|<>]+$").to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(odd[index])])
        return total[offsets[1:]] - total[offsets[:-1]]

    def _capitals(self) -> np.ndarray:
        data, _ = self.get("bytes")
        return self.per_text((data >= 65) & (data <= 90))


def _repeats_exact(w: np.ndarray) -> int:
    """The same count through a dictionary, for a text in which two windows share a hash."""
    seen: dict[bytes, list[int]] = {}
    for i in range(len(w) - WINDOW + 1):
        seen.setdefault(w[i : i + WINDOW].tobytes(), []).append(i)
    covered = np.zeros(len(w), bool)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered[i : i + WINDOW] = True
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``test`` is true."""

    name: str
    test: Callable[[Slice], np.ndarray]


def _share(part: str, whole: str, most: float) -> Callable[[Slice], np.ndarray]:
    return lambda s: s.get(part) > most * s.get(whole)


RULES = (
    Rule("symbol_per_word", _share("n_symbols", "n_words", 0.1)),
    Rule("duplicate_lines", lambda s: (s.get("n_lines") >= 4) & (s.get("n_dup_lines") > 0.5 * s.get("n_lines"))),
    Rule("word_length", lambda s: (s.get("word_chars") < 2 * s.get("n_words")) | (s.get("word_chars") > 25 * s.get("n_words"))),
    Rule("few_letters", lambda s: s.get("letters") < 0.4 * s.get("word_chars")),
    Rule("few_distinct_words", lambda s: (s.get("n_words") >= 200) & (s.get("near_distinct_words") < 0.1 * s.get("n_words"))),
    Rule("marked_words", _share("marked_words", "n_words", 0.2)),
    Rule("stutter", _share("stutters", "n_words", 0.4)),
    Rule("capitals", lambda s: (s.get("n_words") >= 20) & (s.get("capitals") > 0.7 * s.get("letters"))),
)


def base_failed(s: Slice) -> np.ndarray:
    return (s.get("n_words") < 10) | (100 * s.get("n_repeat_words") > 20 * s.get("n_words"))


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per second on at most ``sample_rows`` texts of at most ``SAMPLE_TEXT_BYTES`` bytes.

    Only the order rests on the sample, so neither bound can change a verdict. An empty table keeps the given order.
    """
    spread = F.pmod(F.xxhash64(F.col(text)), F.lit(5)) == 0
    small = F.octet_length(F.col(text)) <= SAMPLE_TEXT_BYTES
    rows = [r[0] for r in docs.select(text).where(spread & small).limit(sample_rows).collect()]
    if not rows:
        return rules
    timed = []
    for rule in rules:
        part = Slice(pa.array(rows, pa.string()))
        for name in STATS:  # known for every text before the first rule runs
            part.get(name)
        start = time.perf_counter()
        rejected = int(rule.test(part).sum())
        timed.append(((rejected + 0.5) / (len(rows) + 1) / max(time.perf_counter() - start, 1e-7), rule))
    return tuple(r for _, r in sorted(timed, key=lambda x: (-x[0], x[1].name)))


def cascade(s: Slice, rules: tuple[Rule, ...]) -> np.ndarray:
    """True for texts that no rule rejects; each rule sees only what the earlier ones kept."""
    alive = np.flatnonzero(~base_failed(s))
    part = s.only(alive)
    for rule in rules:
        if not len(alive):
            break
        rejected = rule.test(part)
        if rejected.any():
            alive, part = alive[~rejected], part.only(np.flatnonzero(~rejected))
    kept = np.zeros(len(s.text), bool)
    kept[alive] = True
    return kept


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` plus ``STATS`` (long), ``base_failed`` and ``kept`` (boolean).

    A null or empty text has no words and fails the base rule (fewer than ten words). Repeated rows each get their own
    row. An empty table gives an empty result. Input columns named like an added one are replaced by it.
    """
    ordered = order_rules(docs, text, rules)
    added = [*STATS, "base_failed", "kept"]
    passed = [c for c in docs.columns if c.lower() not in added or c == text]
    if text.lower() in added:
        raise ValueError(f"the text column cannot be called {text}")
    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField(c, T.LongType()) for c in STATS] + [T.StructField(c, T.BooleanType()) for c in added[-2:]])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            s = Slice(texts(part, text))
            columns = [part.column(i) for i in range(part.num_columns)]
            columns += [pa.array(s.get(c).astype(np.int64)) for c in STATS]
            columns += [pa.array(base_failed(s)), pa.array(cascade(s, ordered))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return docs.select(*passed).mapInArrow(run, schema)


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns."""
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)])
    text = f"in_{names.index('text')}"
    out = quality_rules(inner, text).where("kept")
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])


_WORD = r"'[^\x20\x09-\x0D]+'"
_AFTER = WINDOW - 1
#: The same statistics and rules for DuckDB.
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM documents),
p AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT id, i, word, lag(word) OVER o AS before, CASE WHEN lead(word, {_AFTER}) OVER o IS NOT NULL THEN
    word || {" || ".join(f"' ' || lead(word, {j}) OVER o" for j in range(1, WINDOW))} END AS gram FROM p WINDOW o AS (PARTITION BY id ORDER BY i)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, i + j AS i FROM r, (SELECT unnest(range({WINDOW})) AS j)) GROUP BY id),
s AS (SELECT id, count(DISTINCT (word, (i - 1) // {STRETCH})) AS distinct_words, count(*) FILTER (WHERE word = before) AS stutters,
    count(*) FILTER (WHERE regexp_matches(word, '[!#*$%&|<>]{{2,}}$|^[|<>]+$')) AS marked FROM g GROUP BY id),
b AS (SELECT doc_id, id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    length(regexp_replace(text, '[\x00-@\\[-`{{-\x7F]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM d),
q AS (SELECT b.*, coalesce(rep.n, 0) AS n_repeat_words, coalesce(distinct_words, 0) AS distinct_words, coalesce(stutters, 0) AS stutters, coalesce(marked, 0) AS marked
    FROM b LEFT JOIN rep USING (id) LEFT JOIN s USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT (failed OR n_symbols > 0.1::DOUBLE * n_words
    OR (n_lines >= 4 AND n_dup_lines > 0.5::DOUBLE * n_lines) OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR letters < 0.4::DOUBLE * word_chars
    OR (n_words >= 200 AND distinct_words < 0.1::DOUBLE * n_words) OR marked > 0.2::DOUBLE * n_words OR stutters > 0.4::DOUBLE * n_words
    OR (n_words >= 20 AND capitals > 0.7::DOUBLE * letters)) AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM q)
"""


@llm_query("op1_quality_rules", ORACLE)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *STATS, "base_failed", "kept")
