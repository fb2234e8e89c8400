"""Line deduplication by content-defined chunks of lines, in DataFrame operations only.

A text is cut at line feeds.  Each line has a 32-bit hash, and a rolling hash over the last two line hashes ends a chunk
where it is 0 modulo ``DIVISOR``, so boundaries depend on nearby lines only and survive shifts; the last line always ends
one.  Chunks of two lines or more that occur again anywhere, in another document or the same one, are removed except for
their first place by (doc_id, text hash, chunk number), after their bytes have been compared with that first place's.

Chunks are matched by 128 bits of hash with a grouped minimum (partial aggregation), so a chunk that occurs a million
times moves as a few rows; byte comparison is a join that adaptive execution may split.  Texts are joined with what is
marked in them by a broadcast as long as that is counted to be small, and by a shuffle beyond.  All array work is linear in
the lines of a document.

Boundaries that fall elsewhere in two documents hide most short runs from any one cut.  With ``every`` an exact check
follows on what the chunks leave: each two adjacent lines that do not both stand in a removed chunk are looked up, so every
repeated run of two lines or more is found.  (The first place of a pair is in no removed chunk, as that chunk's own first
place holds the pair too; so leaving these out changes no other.)  A pair that overlaps its own first place is not a repeat.
Each line taken out still stands at an earlier place.

Null texts have no lines and stay null; an empty text is one empty line.  Single-line chunks are never removed.  Rows
equal in doc_id and text are one document for the order and are all returned alike; a null doc_id comes first.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, Tables, join_same, result, table

DIVISOR, LEAST_LINES = 3, 2


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and ``body`` with it; a plain column would be evaluated at each use inside a lambda."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _cut() -> str:
    """SQL for struct(lines, ends) of ``text``: its lines, and the place of each chunk's last line; null for a null text."""
    hashes = "transform(lines, x -> cast(conv(substring(md5(cast(x as binary)), 1, 8), 16, 10) as bigint))"
    ends = f"filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 or (coalesce(get(h, i - 1), 0) * 31 + h[i]) % {DIVISOR} = 0)"
    return let("lines", "split(text, '\\n', -1)", f"if(lines is null, null, {let('h', hashes, f'named_struct({chr(39)}lines{chr(39)}, lines, {chr(39)}ends{chr(39)}, {ends})')})")


def _start(k: str) -> str:
    return f"if({k} = 0, 0, s.ends[{k} - 1] + 1)"


def _lines(k: str) -> str:
    """SQL for the lines of chunk ``k`` of the cut text ``s``."""
    return f"slice(s.lines, {_start(k)} + 1, s.ends[{k}] - {_start(k)} + 1)"


_LINES = "split(text, '\\n', -1)"
#: SQL for the two lines that chunk ``k`` of ``every`` holds, of the lines ``s``
_PAIR = "array_join(slice(s, {k} + 1, 2), '\\n')"


def beside(marked: DataFrame, entries: str) -> DataFrame:
    """A written table of documents with arrays ``entries``: broadcast if it has been counted to be small, so that texts stay where they are."""
    size = marked.agg(F.sum(1 + F.size(entries))).first()[0] or 0
    return F.broadcast(marked) if size <= BROADCAST_ROWS else marked


def repeated_chunks(docs: DataFrame, tables: Tables, every: bool = False) -> DataFrame:
    """doc_id, dl_text (hash of the text), k: the chunks to be removed (``every``: the pairs of lines). ``docs``: doc_id, text."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("dl_text"))
    if every:
        own = repeated_chunks(docs, tables).groupBy("doc_id", "dl_text").agg(F.collect_set("k").alias("own"))
        own = beside(tables.put(own, "own-chunks"), "own")
        pairs = F.expr(let("s", _cut(), f"flatten(transform(own, k -> sequence({_start('k')}, s.ends[k] - 1)))"))
        inside = tables.put(join_same(keyed, own, ["doc_id", "dl_text"]).select("doc_id", "dl_text", pairs.alias("own")).distinct(), "inside")
        keyed = join_same(keyed, beside(inside, "own"), ["doc_id", "dl_text"], "left")
    chunk = let("t", f"array_join({_lines('k')}, '\\n')", f"named_struct('k', k, 'n', e - {_start('k')} + 1, 'a', xxhash64(t), 'b', xxhash64(7, t))")
    found = let("s", _cut(), f"filter(transform(s.ends, (e, k) -> {chunk}), c -> c.n >= {LEAST_LINES})")
    if every:
        pair = let("t", _PAIR.format(k="k"), "named_struct('k', k, 'a', xxhash64(t), 'b', xxhash64(7, t))")
        found = let("s", _LINES, f"if(size(s) < 2, null, transform(array_except(sequence(0, size(s) - 2), coalesce(own, cast(array() as array<int>))), k -> {pair}))")
    chunks = keyed.withColumn("c", F.expr(found))
    places = chunks.select("doc_id", "dl_text", F.explode("c").alias("c")).select("doc_id", "dl_text", "c.k", "c.a", "c.b")
    places = tables.put(places.distinct(), "chunks")
    first = places.groupBy("a", "b").agg(F.min(F.struct("doc_id", "dl_text", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = tables.put(first, "repeated")  # so both sides of the join are exchanges, which adaptive execution can split
    again = places.join(first, ["a", "b"])
    if every:
        again = again.filter("not (first.doc_id <=> doc_id and first.dl_text = dl_text and k = first.k + 1)")
    is_first = F.col("first") == F.struct("doc_id", "dl_text", "k")
    wanted = again.groupBy("doc_id", "dl_text").agg(F.collect_list(F.struct("k", "a", "b", is_first.alias("first"))).alias("wanted"))
    texts = join_same(keyed, beside(tables.put(wanted, "wanted"), "wanted"), ["doc_id", "dl_text"])
    bytes_of = _PAIR.format(k="w.k") if every else f"array_join({_lines('w.k')}, '\\n')"
    cut = F.expr(let("s", _LINES if every else _cut(), f"transform(wanted, w -> named_struct('w', w, 'bytes', {bytes_of}))"))
    bytes_ = tables.put(texts.select("doc_id", "dl_text", F.explode(cut).alias("x")).select("doc_id", "dl_text", "x.w.*", "x.bytes"), "bytes")
    kept = bytes_.filter("first").select("a", "b", F.col("bytes").alias("first_bytes")).dropDuplicates(["a", "b"])
    same = bytes_.filter("not first").join(kept, ["a", "b"]).filter("bytes = first_bytes")
    same = same.select("doc_id", "dl_text", "k")
    return same.unionByName(inside.select("doc_id", "dl_text", F.explode("own").alias("k"))) if every else same


def dedup_lines(docs: DataFrame, every: bool = False) -> DataFrame:
    """``docs`` with repeated chunks (``every``: of all cuts) taken out of ``text``, and dl_n_lines, dl_n_removed, dl_n_chunks_removed.

    Columns of ``docs`` pass through whatever their names, but for three of these last names, which are replaced.
    """
    names = {c: c if c in ("doc_id", "text") else f"own_{k}" for k, c in enumerate(docs.columns)}
    docs = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()])
    with Tables(docs.sparkSession, "line-dedup") as tables:
        gone = repeated_chunks(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), tables, every)
        removed = result(gone.groupBy("doc_id", "dl_text").agg(F.collect_set("k").alias("dl_gone")), "removed-chunks")
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn("dl_text", F.xxhash64("text"))
    both = join_same(keyed, beside(removed, "dl_gone"), ["doc_id", "dl_text"], "left")
    stay = f"flatten(transform(array_except(sequence(0, size(s.ends) - 1), dl_gone), k -> {_lines('k')}))"
    if every:
        stay = "transform(array_except(sequence(0, size(s) - 1), flatten(transform(dl_gone, k -> array(k, k + 1)))), i -> s[i])"
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    left = both.withColumn("dl_n_lines", lines).withColumn("dl_left", F.expr(f"if(dl_gone is null, null, {let('s', _LINES if every else _cut(), stay)})"))
    text = F.expr("if(dl_gone is null, text, array_join(dl_left, '\n'))").alias("text")
    gone = F.when(F.col("dl_gone").isNull(), 0).otherwise(F.col("dl_n_lines") - F.size("dl_left")).cast("long")
    parts = F.when(F.col("dl_gone").isNull(), 0).otherwise(F.size("dl_gone")).cast("long")
    added = ("dl_n_lines", "dl_n_removed", "dl_n_chunks_removed")
    return left.select(*[text if c == "text" else F.col(x).alias(c) for c, x in names.items() if c not in added], "dl_n_lines", gone.alias("dl_n_removed"), parts.alias("dl_n_chunks_removed"))


def op8_line_dedup(spark, sf_dir: str, every: bool = False) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), every)
    return rows.select("doc_id", F.col("dl_n_lines").alias("n_lines"), F.col("dl_n_removed").alias("n_removed"), F.col("dl_n_chunks_removed").alias("n_chunks_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_line_dedup_every_run(spark, sf_dir: str) -> DataFrame:
    return op8_line_dedup(spark, sf_dir, True)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS lh FROM l),
b AS (SELECT *, (coalesce(lag(lh) OVER w, 0) * 31 + lh) % 3 = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes FROM k GROUP BY doc_id, k),
g AS (SELECT doc_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, k) AS r FROM c WHERE n >= 2) WHERE r > 1),
gs AS (SELECT doc_id, sum(n) AS lines_gone, count(*) AS chunks_gone FROM g GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = k.doc_id AND g.k = k.k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines_gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(chunks_gone, 0) AS BIGINT) AS n_chunks_removed, sha256(coalesce(s.t, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN gs USING (doc_id) LEFT JOIN s USING (doc_id)
"""

ORACLE_EVERY_RUN = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT * FROM (SELECT doc_id, i AS k, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS bytes FROM l) WHERE bytes IS NOT NULL),
r AS (SELECT doc_id, k, row_number() OVER w AS r, first_value(doc_id) OVER w AS fd, first_value(k) OVER w AS fk FROM p WINDOW w AS (PARTITION BY bytes ORDER BY doc_id, k)),
g AS (SELECT doc_id, k FROM r WHERE r > 1 AND NOT (doc_id = fd AND k = fk + 1)),
gs AS (SELECT doc_id, count(*) AS chunks_gone FROM g GROUP BY doc_id),
gl AS (SELECT doc_id, k AS i FROM g UNION SELECT doc_id, k + 1 FROM g),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM gl WHERE gl.doc_id = l.doc_id AND gl.i = l.i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) - coalesce(s.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(chunks_gone, 0) AS BIGINT) AS n_chunks_removed, sha256(coalesce(s.t, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN gs USING (doc_id) LEFT JOIN s USING (doc_id)
"""
