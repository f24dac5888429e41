"""Grouping of spelling variants: words within one edit, by automata over halves.

Words are the maximal runs of letters of all texts, lower-cased in A to Z only.  Two words are
near if exactly one inserted, deleted or replaced code point tells them apart.  A word's form is
its most frequent near word, if that is ``ratio`` times as frequent; following forms leads to its root.

1. Tasks count the words of their texts before Spark adds the counts up.
2. Every word has two segments, its halves.  One edit leaves a half of a word whole: its first
   half begins the other word, or its second half ends it.  Each shard holds an Aho-Corasick
   automaton of the halves of its words and scans words with it; a match counts
   if it lies where the half must lie and the lengths differ by one at most, and the rest of the two words is compared.
   As a half is three letters long at least, a word meets those that share its first or last three letters,
   whose shard these letters name.
3. A shard reports, for each scanned word, how many near words it found and the most frequent one,
   never the pairs.  The second half finds a pair only where the first half does not, so none counts twice.

Crowded places are split without loss.  Letters that more than ``CROWD`` words share are
refined to whole halves and a length; if more than ``CROWD`` words still share them, they are dealt into chunks and
the scanned words visit every chunk.  Within a shard the rests of words of one half and length are
compared one by one where they are few (``FEW``), and else looked up by their patterns with one hole.

Defined cases: a null or empty text has no words; a null doc_id reads as an empty string where
typing slips are drawn; rows that repeat count again; ties of frequency go to the
smaller word in code-point order; texts of any length are read in stretches cut between words; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, sized, small

#: words that a task counts before it emits them
HELD = 400_000
#: characters of a text that are read at once
LONG = 1_000_000
#: words that share their first or last letters before these are refined, and words of a chunk
CROWD = 20_000
#: words of one half and length that are compared one by one
FEW = 12
#: words a shard on average
SHARD = 20_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HOLE = "\0"

Slip = Callable[[str, str], str]


def crc_slips(every: int = 199) -> Slip:
    """Planted typing slips: a word whose crc32 with its document divides by ``every`` loses one letter."""

    def slip(doc_id: str, word: str) -> str:
        h = zlib.crc32(f"{doc_id}:{word}".encode())
        if h % every:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return slip


def _runs(text: str) -> Counter:
    found: Counter = Counter()
    at = 0
    while len(text) - at > LONG:
        here = _BREAK.search(text, at + LONG)
        if not here:
            break
        found.update(_RUN.findall(text[at : here.start()].translate(_LOWER)))
        at = here.start()
    found.update(_RUN.findall(text[at:].translate(_LOWER)))
    return found


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, slip: Slip | None = None) -> DataFrame:
    """(word, n) of the words of ``shortest`` code points and ``least`` occurrences at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in small(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in _runs(text or "").items():
                    if len(word) >= shortest:
                        word = slip(doc_id, word) if slip else word
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) >= HELD:
                    yield emit()
                    held.clear()
        yield emit()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :] and len(b) - len(a) <= 1


class Group:
    """Words of one half and one length, by their rests (what the half leaves of them)."""

    def __init__(self):
        self.words: list[int] = []
        self.rests: list[str] = []
        self.whole: dict[str, int] | None = None
        self.holes: dict[str, list[int]] = {}

    def add(self, word: int, rest: str) -> None:
        self.words.append(word)
        self.rests.append(rest)

    def near(self, rest: str) -> set[int]:
        """Words whose rest is one edit from ``rest``."""
        if len(self.words) <= FEW:
            return {w for w, r in zip(self.words, self.rests) if one_edit(r, rest)}
        if self.whole is None:
            self.whole = dict(zip(self.rests, self.words))
            for w, r in zip(self.words, self.rests):
                for i in range(len(r)):
                    self.holes.setdefault(r[:i] + _HOLE + r[i + 1 :], []).append(w)
        size = len(self.rests[0])
        if size < len(rest):
            return {self.whole[s] for s in {rest[:i] + rest[i + 1 :] for i in range(len(rest))} if s in self.whole}
        same = size == len(rest)
        patterns = {rest[:i] + _HOLE + rest[i + same :] for i in range(len(rest) + (not same))}
        found = {w for p in patterns for w in self.holes.get(p, ())}
        found.discard(self.whole.get(rest) if same else None)
        return found


def _shard(table: pa.Table) -> pa.Table:
    """Near words of the scanned words of a shard: (word, n_near, best_n, best)."""
    import ahocorasick

    words, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
    first_side, files, scans = (table.column(c).to_pylist() for c in ("first", "files", "scans"))
    machine = ahocorasick.Automaton()
    for i, word in enumerate(words):
        if files[i]:
            half = len(word) // 2
            segment, rest = (word[:half], word[half:]) if first_side[i] else (word[half:], word[:half])
            held = machine.get(segment, None)
            if held is None:
                held = {}
                machine.add_word(segment, (len(segment), held))
            else:
                held = held[1]
            group = held.get((first_side[i], len(word)))
            if group is None:
                group = held[first_side[i], len(word)] = Group()
            group.add(i, rest)
    out: list[tuple[str, int, int, str]] = []
    if len(machine):
        machine.make_automaton()
        # a word that visits several keys or chunks of this shard is scanned once
        for word, first in dict.fromkeys((w, f) for w, f, scan in zip(words, first_side, scans) if scan):
            size, near = len(word), set()
            for end, (length, held) in machine.iter(word):
                if end - length + 1 if first else end != size - 1:  # the half must begin or end the word
                    continue
                rest = word[length:] if first else word[: size - length]
                for other in (size - 1, size, size + 1):
                    group = held.get((first, other))
                    if group:
                        near |= group.near(rest)
            if not first:  # these are found by their first half
                near = {w for w in near if not word.startswith(words[w][: len(words[w]) // 2])}
            if near:
                best = min(near, key=lambda w: (-counts[w], words[w]))
                out.append((word, len(near), counts[best], words[best]))
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def _routed(words: DataFrame, shortest: int) -> DataFrame:
    """(key, word, n, first, files, scans): where every word is filed and where it is scanned."""
    size = F.length("word")
    sides = words.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    letters = F.when(F.col("first"), F.substring("word", 1, 3)).otherwise(F.substring("word", -3, 3))
    rows = sides.withColumn("key", F.concat(F.when(F.col("first"), "<").otherwise(">"), letters))
    crowded = sized(cut(rows.groupBy("key").count().filter(F.col("count") > CROWD).select("key", F.lit(True).alias("crowded"))))
    rows = cut(rows.join(crowded, "key", "left"))
    plain = rows.filter("crowded is null").select("key", "word", "n", "first", F.lit(True).alias("files"), F.lit(True).alias("scans"))
    # a crowded key is refined to a length and the half that a word of that length would share
    other = F.col("other")
    half = F.when(F.col("first"), F.substring(F.col("word"), F.lit(1), F.floor(other / 2).cast("int"))).otherwise(
        F.expr("substring(word, greatest(1, length(word) - (other - int(floor(other / 2))) + 1), other)")
    )
    lengths = F.explode(F.array(size - 1, size, size + 1)).alias("other")
    fine = rows.filter("crowded").select("key", "word", "n", "first", lengths).filter(other >= shortest)
    fine = fine.select(F.concat_ws(":", F.substring("key", 1, 1), other.cast("string"), half).alias("key"), "word", "n", "first", (other == size).alias("files"), F.lit(True).alias("scans"))
    rows = plain.unionAll(fine)
    filed = rows.filter("files").groupBy("key").count().filter(F.col("count") > CROWD)
    chunks = sized(cut(filed.select("key", F.ceil(F.col("count") / CROWD).cast("int").alias("chunks"))))
    rows = rows.join(chunks, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own = F.pmod(F.xxhash64("word"), F.col("chunks")) == F.col("chunk")
    return rows.select("key", "chunk", "word", "n", "first", (F.col("files") & own).alias("files"), "scans")


def near_words(words: DataFrame, shortest: int = 6) -> DataFrame:
    """(word, n_near, best_n, best): number of near words of every word that has any, and the most frequent one.

    ``words`` are different words (word, n) of ``shortest`` code points at least, six or more.
    """
    if shortest < 6:
        raise ValueError("halves of three letters need words of six")
    shards = max(4 * shuffle_parts(words.sparkSession), math.ceil(2 * words.count() / SHARD))
    rows = _routed(words, shortest).withColumn("shard", F.pmod(F.xxhash64("key", "chunk"), F.lit(shards)))
    found = rows.groupBy("shard").applyInArrow(_shard, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, root) of rows (word, form, n): from each word along the forms, by doubling.

    A form is ``ratio`` times as frequent as its word, so the largest count bounds the length of every path.
    """
    most = forms.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)) + 1)
    known = cut(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps))):
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = cut(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return known


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, slip: Slip | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = cut(word_counts(docs, shortest, least, slip))
    found = words.join(near_words(words, shortest), "word", "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    forms = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")))
    out = forms.join(roots(forms, ratio), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: the registered query in DuckDB: crc32 over bytes by its polynomial, near words by patterns with one hole
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
entries AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT row_number() OVER () AS r, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM counted),
crc AS (
  SELECT r, 4294967295::BIGINT AS c, 0 AS k FROM coded
  UNION ALL
  SELECT crc.r, xor(c >> 8, (SELECT l FROM entries)[1 + (xor(c, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) & 255)]), k + 1
  FROM crc JOIN coded USING (r) WHERE 2 * k < length(h)),
slipped AS (
  SELECT CASE WHEN xor(c, 4294967295) % 199 = 0
         THEN substr(run, 1, (xor(c, 4294967295) % length(run))::INT) || substr(run, (xor(c, 4294967295) % length(run))::INT + 2) ELSE run END AS word, n
  FROM crc JOIN coded USING (r) WHERE 2 * k = length(h)),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, substr(word, 1, i::INT) || '*' || substr(word, i::INT + 2) AS p FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
longer AS (SELECT word, n, substr(word, 1, i::INT) || '*' || substr(word, i::INT + 1) AS p FROM words, LATERAL (SELECT unnest(range(length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b USING (p) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM longer a JOIN holes b USING (p)
  UNION SELECT b.word, a.word, a.n FROM longer a JOIN holes b USING (p)),
ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM pairs),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (word)),
paths AS (SELECT word, word AS root FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON p.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p USING (word) JOIN forms e ON p.root = e.word WHERE e.form IS NULL
"""
