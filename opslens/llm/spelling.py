"""Spelling variants grouped around their commonest form, by asymmetric q-chunks.

Two words are near when one code point inserted, deleted or replaced makes one
into the other. The longer word (or either of two equally long ones) is cut into
two disjoint chunks; the other gives its positional grams of the same sizes. One
edit leaves a chunk whole: the first at its own place, the second shifted by the
difference of the lengths, so by one place at most. Grams at other places can
match no chunk and are not made. Words that meet in a chunk are verified on what
is left of them beside it.

A chunk that very many words have (a common ending) would bring all of them
together. Chunks are therefore counted first; in one with more than ``HOT``
words, what is left beside it is cut into two chunks and positional grams in
turn, until no key is hot. A key that leaves one code point open is shared by no
more words than there are letters, so this ends after about log2(length) turns,
loses no pair, and no task meets more than ``HOT`` words at a key.

Everything is DataFrame code; what moves are distinct words that occur often
enough, not their occurrences.

Nulls and odd rows: a null or empty text has no words; a null ``doc_id`` counts
as an empty one in the hash; a repeated row counts as often as it occurs; words
of equal number go by code-point order; very long runs are words like others; an
empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import cut, table

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: One in so many (document, run) pairs loses a code point.
THINNED = 199
#: More words than this at one chunk: the chunk is refined. Above the number of letters.
HOT = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(run: Column) -> Column:
    """A-Z lowered and nothing else (plain ``lower`` would change À-Þ too)."""
    return F.when(run.rlike("[\\u00C0-\\u00DE]"), F.translate(run, UPPER, LOWER)).otherwise(F.lower(run))


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, thinned: int = THINNED) -> DataFrame:
    """word, n: maximal runs of letters of ``docs`` (doc_id, text), lowered and
    thinned, with at least ``min_length`` code points and ``min_count`` occurrences."""
    # a thinned run only gets shorter: shorter runs need not be looked at
    pattern = f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    runs = runs.select("doc", _ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % thinned == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return (runs.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _split(rows: DataFrame) -> DataFrame:
    """Every row (key, short, word, n, rest) as two: the first or the second chunk
    of ``rest`` moves to the key, the other stays. ``short`` rows hold the grams of
    a word one code point shorter than the one whose chunks they are to match."""
    rest, shift = F.col("rest"), F.col("short").cast("int")
    half = F.floor((F.char_length("rest") + shift) / 2).cast("int")  # size of the longer word's first chunk
    end = F.char_length("rest")
    first, after_first = rest.substr(F.lit(1), half), rest.substr(half + 1, end)
    second, before_second = rest.substr(half + 1 - shift, end), rest.substr(F.lit(1), half - shift)
    both = F.array(F.struct(F.concat_ws("", "key", F.lit("<"), first).alias("key"), after_first.alias("rest")),
                   F.struct(F.concat_ws("", "key", F.lit(">"), second).alias("key"), before_second.alias("rest")))
    return rows.select("short", "word", "n", F.explode(both).alias("part")).select("part.key", "short", "word", "n", "part.rest")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """a, a_n, b, b_n: every unordered pair of near words of ``words`` (word, n;
    each word once, of at least two code points), once."""
    own = words.select(F.char_length("word").cast("string").alias("key"), F.lit(False).alias("short"), "word", "n", F.col("word").alias("rest"))
    grams = own.withColumns({"key": (F.char_length("word") + 1).cast("string"), "short": F.lit(True)})
    rows, found = cut(_split(own.unionByName(grams))), None
    while True:
        crowded = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("here")).where(F.col("here") > hot).select("key"))
        last = crowded.isEmpty()
        calm = rows if last else rows.join(crowded, "key", "left_anti")
        left = calm.where(~F.col("short"))
        other = calm.select("key", F.col("short").alias("o_short"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("o_rest"))
        pairs = (left.join(other, "key").where((F.col("o_short") | (F.col("word") < F.col("b"))) & (F.levenshtein("rest", "o_rest", 1) == 1))
                 .select(F.col("word").alias("a"), F.col("n").alias("a_n"), "b", "b_n"))
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found.distinct()  # of a doubled letter, both chunks can be whole
        rows = cut(_split(rows.join(crowded, "key", "left_semi")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of ``forms`` (word, form): forms followed to the
    last, by doubling the steps taken. Counts grow along forms, so they end."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n):
    ``form`` is the near word of largest n (ties: smallest), if that is at least
    ``ratio`` times the word's own."""
    words = cut(words)
    pairs = near_pairs(words, hot)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("b_n").alias("o_n")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("a_n").alias("o_n"))))
    around = (pairs.select(both.alias("p")).select("p.*")
              .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("m"), "o")).alias("best")))
    held = F.col("best.m") <= -F.col("n") * ratio
    near = cut(words.join(around, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, F.col("best.o")).alias("form"), F.when(held, -F.col("best.m")).alias("form_n")))
    return (near.join(_roots(near.where(F.col("form").isNotNull())), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def query(spark, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents")))


#: Another route: CRC-32 from its table, near words from deletion neighbourhoods.
ORACLE_SQL = """
WITH RECURSIVE crc_steps AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8),
raw AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
runs AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM raw WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(string_split(doc || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END))),
      lambda acc, byte: xor(acc >> 8, t[(xor(acc, byte) & 255) + 1]))) AS h
  FROM runs, crc_table),
thinned AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS o, b.n AS o_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN w b ON a.rest = b.word),
best AS (SELECT word, o, o_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY o_n DESC, o) AS r FROM near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= 5 * w.n THEN o END AS form, CASE WHEN o_n >= 5 * w.n THEN o_n END AS form_n
          FROM w LEFT JOIN best ON w.word = best.word AND r = 1),
walk AS (
  SELECT word, word AS at, 0 AS hops FROM forms
  UNION ALL SELECT walk.word, forms.form, hops + 1 FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, arg_max(walk.at, walk.hops) AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word GROUP BY f.word, f.form, f.n, f.n_near, f.form_n
"""
