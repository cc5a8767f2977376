"""The registered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomline.functions import sequence as sq
from loomline.operators import components as cc
from loomline.operators import graph, intervals, search, seeds, synteny
from loomline.operators import kmers as km
from loomline.operators.shared import checkpointed
from loomline.sources import formats
from loomline.sources.adapters import document_sequences, event_sequences, read

K = graph.K
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) by its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


SEQS = f"""seqs AS (SELECT doc_id AS chr, concat(source, '.doc', doc_id) AS name,
  translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{sq.LETTERS}', '{sq.BASES}') AS seq FROM documents)"""
KMERS = f"""{SEQS}, places AS (SELECT chr, seq, unnest(range(1, greatest(length(seq) - {K - 2}, 1))) AS p FROM seqs),
kmers AS (SELECT chr, p - 1 AS pos, substr(seq, p, {K}) AS kmer, CASE WHEN p > 1 THEN substr(seq, p - 1, 1) ELSE '' END AS prev, substr(seq, p + {K}, 1) AS next FROM places),
turned AS (SELECT *, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM kmers),
oriented AS MATERIALIZED (SELECT chr, pos, prev, next, least(kmer, rc) AS canon, CASE WHEN kmer < rc THEN 1 ELSE -1 END AS strand,
  CASE WHEN kmer < rc THEN prev ELSE translate(next, 'ACGT', 'TGCA') END AS entering,
  CASE WHEN kmer < rc THEN next ELSE translate(prev, 'ACGT', 'TGCA') END AS leaving FROM turned)"""
PACKED = f"list_sum(list_transform(range(1, {K + 1}), lambda i: (instr('ACGT', substr(canon, i, 1)) - 1)::BIGINT << ({2 * K} - 2 * i)))::BIGINT + 1"
VERTICES = f"""{KMERS}, vertices AS MATERIALIZED (SELECT canon, count(*) AS abundance, {PACKED} AS vertex FROM oriented GROUP BY canon
  HAVING count(DISTINCT entering) > 1 OR count(DISTINCT leaving) > 1 OR bool_or(entering = '') OR bool_or(leaving = ''))"""
INDEX = f"""{VERTICES}, jx AS MATERIALIZED (SELECT chr, pos, vertex * strand AS vid, next AS ch,
  CASE WHEN prev = '' THEN 'N' ELSE translate(prev, 'ACGT', 'TGCA') END AS rev_ch, row_number() OVER (PARTITION BY chr ORDER BY pos) - 1 AS idx
  FROM oriented JOIN vertices USING (canon) WHERE abundance < {graph.ABUNDANCE})"""
STRANDS = f"""{INDEX}, occ AS MATERIALIZED (SELECT vid, chr, idx, pos, 1 AS strand, ch FROM jx UNION ALL SELECT -vid, chr, idx, pos, -1, rev_ch FROM jx)"""


def seqs_of(spark, sf_dir: str) -> DataFrame:
    return document_sequences(read(spark, sf_dir, "documents"))


def index_of(spark, sf_dir: str) -> DataFrame:
    return graph.index(seqs_of(spark, sf_dir), K, graph.ABUNDANCE)


# scans and scalar functions


@query(f"WITH {SEQS} SELECT chr, name, md5(seq) AS seq_md5 FROM seqs")
def seq_scan(spark, sf_dir):
    return seqs_of(spark, sf_dir).select("chr", "name", F.md5("seq").alias("seq_md5"))


@query(f"WITH {SEQS} SELECT chr, name, length(seq) AS size FROM seqs")
def seq_lengths(spark, sf_dir):
    return seqs_of(spark, sf_dir).select("chr", "name", "size")


@query(f"WITH {SEQS} SELECT chr, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM seqs")
def revcomp(spark, sf_dir):
    return seqs_of(spark, sf_dir).select("chr", F.md5(sq.reverse_complement(F.col("seq"))).alias("rc_md5"))


@query(f"WITH {SEQS} SELECT chr, length(seq) > 0 AND regexp_full_match(seq, '[ACGT]*') AS definite, md5(rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10))) AS lines_md5, (length(seq) + 79) // 80 AS n_lines FROM seqs")
def fasta_lines(spark, sf_dir):
    lines = F.split(sq.wrapped(F.col("seq")), "\n")
    n = F.when(F.col("size") > 0, F.size(lines)).otherwise(0).cast("long")
    return seqs_of(spark, sf_dir).select("chr", sq.is_definite(F.col("seq")).alias("definite"), F.md5(F.array_join(lines, "\n")).alias("lines_md5"), n.alias("n_lines"))


@query(f"WITH {SEQS} SELECT name, md5(concat('>', name, chr(10), rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)))) AS record_md5 FROM seqs")
def fasta_records(spark, sf_dir):
    records = formats.fasta_lines(seqs_of(spark, sf_dir))
    return records.select(F.regexp_extract("value", r"\A>([^\n]*)", 1).alias("name"), F.md5("value").alias("record_md5"))


def counted_of(spark, sf_dir: str) -> DataFrame:
    return km.counted(checkpointed(km.pieces(seqs_of(spark, sf_dir), K, km.COUNT_PIECE)), K)


def vertices_of(spark, sf_dir: str) -> DataFrame:
    return km.junction_vertices(checkpointed(km.pieces(seqs_of(spark, sf_dir), K)), K)


@query(f"WITH {KMERS} SELECT canon, count(*) AS n, sum(strand)::BIGINT AS strands FROM oriented GROUP BY canon")
def canonical_kmers(spark, sf_dir):
    return counted_of(spark, sf_dir).select(sq.unpack(F.col("packed"), K).alias("canon"), "n", "strands")


@query(f"WITH {KMERS} SELECT canon, {PACKED} - 1 AS packed FROM (SELECT DISTINCT canon FROM oriented)")
def kmer_pack(spark, sf_dir):
    return counted_of(spark, sf_dir).select(sq.unpack(F.col("packed"), K).alias("canon"), "packed")


@query(f"WITH {KMERS} SELECT n AS abundance, count(*) AS kmers FROM (SELECT count(*) AS n FROM oriented GROUP BY canon) GROUP BY n")
def kmer_abundance(spark, sf_dir):
    return counted_of(spark, sf_dir).groupBy(F.col("n").alias("abundance")).agg(F.count("*").alias("kmers"))


# the junction graph


@query(f"WITH {VERTICES} SELECT vertex, abundance FROM vertices")
def junctions(spark, sf_dir):
    return vertices_of(spark, sf_dir)


@query(f"WITH {VERTICES} SELECT abundance < {graph.ABUNDANCE} AS kept, count(*) AS vertices, sum(abundance)::BIGINT AS occurrences FROM vertices GROUP BY 1")
def abundance_filter(spark, sf_dir):
    return vertices_of(spark, sf_dir).groupBy((F.col("abundance") < graph.ABUNDANCE).alias("kept")).agg(F.count("*").alias("vertices"), F.sum("abundance").alias("occurrences"))


@query(f"WITH {INDEX} SELECT chr, idx, pos, vid FROM jx")
def junction_index(spark, sf_dir):
    return index_of(spark, sf_dir).select("chr", "idx", "pos", "vid")


@query(f"WITH {INDEX} SELECT chr, idx, vid, ch, rev_ch FROM jx")
def occurrence_chars(spark, sf_dir):
    return index_of(spark, sf_dir).select("chr", "idx", "vid", "ch", "rev_ch")


STEPS = """steps AS MATERIALIZED (SELECT a.chr, a.idx, a.vid AS start, b.vid AS "end", a.ch, b.rev_ch, b.pos - a.pos AS length FROM jx a JOIN jx b ON a.chr = b.chr AND b.idx = a.idx + 1)"""


@query(f'WITH {INDEX}, {STEPS} SELECT chr, idx, start, "end", ch, rev_ch, length FROM steps')
def edges_out(spark, sf_dir):
    return graph.edges(index_of(spark, sf_dir))


@query(f'WITH {INDEX}, {STEPS} SELECT chr, idx, -"end" AS start, -start AS "end", rev_ch AS ch, ch AS rev_ch, length FROM steps')
def edges_in(spark, sf_dir):
    return graph.reversed_edges(graph.edges(index_of(spark, sf_dir)))


@query(
    f'WITH {INDEX}, {STEPS}, both_ways AS (SELECT start, "end", ch, length FROM steps UNION ALL SELECT -"end", -start, rev_ch, length FROM steps) '
    'SELECT start, "end", ch, count(*) AS capacity, min(length) AS shortest FROM both_ways GROUP BY start, "end", ch'
)
def edge_multiplicity(spark, sf_dir):
    steps = graph.edges(index_of(spark, sf_dir))
    ways = F.array(F.struct("start", "end", "ch"), F.struct((-F.col("end")).alias("start"), (-F.col("start")).alias("end"), F.col("rev_ch").alias("ch")))
    both = steps.select("length", F.inline(ways))
    return both.groupBy("start", "end", "ch").agg(F.count("*").alias("capacity"), F.min("length").alias("shortest"))


@query(f"WITH {STRANDS} SELECT vid, chr, idx, pos, strand, ch FROM occ")
def both_strand_union(spark, sf_dir):
    return graph.both_strands(index_of(spark, sf_dir))


SEEDS = f"""{STRANDS.replace("WITH ", "")}, pw(i, p) AS (SELECT 0, 1::HUGEINT UNION ALL SELECT i + 1, p * 31 % 18446744073709551616 FROM pw WHERE i < {graph.ABUNDANCE - 1}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY vid, ch ORDER BY chr, idx) - 1 AS i FROM occ),
weighed AS (SELECT numbered.*, chr * p % 18446744073709551616 AS term FROM numbered JOIN pw USING (i)),
seeds AS (SELECT vid, ch, count(*) AS n, sum(term) % 18446744073709551616 AS r, min(CASE WHEN strand > 0 THEN {{'pos': pos, 'chr': chr}} END) AS f FROM weighed GROUP BY vid, ch
  HAVING count(*) > 1 AND bool_or(strand > 0))"""


@query(f"WITH RECURSIVE {SEEDS} SELECT vid, ch, n, r::HUGEINT::VARCHAR AS rank, f.pos AS pos, f.chr AS chr FROM seeds")
def bundles(spark, sf_dir):
    return seeds.bundles(graph.both_strands(index_of(spark, sf_dir)))


@query(f"WITH RECURSIVE {SEEDS} SELECT vid, ch, n, r::HUGEINT::VARCHAR AS rank, f.pos AS pos, f.chr AS chr FROM seeds ORDER BY n DESC, r::HUGEINT, f.pos, f.chr LIMIT 256")
def bundle_top_k(spark, sf_dir):
    return seeds.top_seeds(seeds.bundles(graph.both_strands(index_of(spark, sf_dir))), 256)


@query(f"WITH {INDEX}, own AS (SELECT DISTINCT chr, abs(vid) AS vertex FROM jx) SELECT a.chr AS chr_x, b.chr AS chr_y, count(*) AS shared FROM own a JOIN own b ON a.vertex = b.vertex AND a.chr < b.chr GROUP BY 1, 2")
def shared_junction_pairs(spark, sf_dir):
    return seeds.cooccurrence(index_of(spark, sf_dir))


@query(f"WITH {INDEX} SELECT abs(vid) AS vertex, count(*) AS occurrences, count(DISTINCT chr) AS sequences FROM jx GROUP BY 1")
def vertex_occurrences(spark, sf_dir):
    own = index_of(spark, sf_dir).groupBy(F.abs("vid").alias("vertex"), "chr").agg(F.count("*").alias("n"))
    return own.groupBy("vertex").agg(F.sum("n").alias("occurrences"), F.count("*").alias("sequences"))


@query(
    f"WITH {STRANDS}, ahead AS (SELECT vid, chr, strand, idx + s * strand AS idx FROM occ, range(1, {seeds.LOOK_AHEAD}) r(s)), "
    "met AS (SELECT ahead.vid, o.vid AS next_vid, count(*) AS votes FROM ahead JOIN occ o USING (chr, strand, idx) GROUP BY 1, 2) "
    "SELECT vid, next_vid, votes FROM met QUALIFY row_number() OVER (PARTITION BY vid ORDER BY votes DESC, next_vid) = 1"
)
def lookahead_votes(spark, sf_dir):
    return seeds.votes(graph.both_strands(index_of(spark, sf_dir)))


@query(
    f"""WITH {STRANDS}, ahead AS MATERIALIZED (SELECT o.vid, o.chr, o.idx, x.vid AS next_vid, (x.pos - o.pos) * o.strand AS d FROM occ o JOIN occ x
  ON o.chr = x.chr AND o.strand = x.strand AND (x.pos - o.pos) * o.strand BETWEEN 1 AND {search.BRANCH}),
own AS (SELECT chr, idx, vid, min(d) AS stop FROM ahead WHERE abs(vid) = abs(next_vid) GROUP BY ALL),
near AS (SELECT vid, next_vid, min(d) AS distance, NULL::VARCHAR AS edge, chr, idx FROM ahead LEFT JOIN own USING (chr, idx, vid)
  WHERE abs(vid) <> abs(next_vid) AND (stop IS NULL OR d < stop) GROUP BY vid, next_vid, chr, idx),
far AS (SELECT o.vid, x.vid AS next_vid, abs(x.pos - o.pos) AS distance, o.ch AS edge, o.chr, o.idx FROM occ o JOIN occ x ON o.chr = x.chr AND o.strand = x.strand AND x.idx = o.idx + o.strand
  WHERE abs(x.pos - o.pos) > {search.BRANCH} AND abs(o.vid) <> abs(x.vid)),
votes AS (SELECT vid, next_vid, edge, count(*) AS votes, min(distance) AS distance, min({{'chr': chr, 'idx': idx}}) AS origin FROM (FROM near UNION ALL FROM far) GROUP BY vid, next_vid, edge HAVING count(*) > 1),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY vid ORDER BY votes DESC, origin.chr, origin.idx, distance, next_vid, edge DESC NULLS LAST) = 1)
SELECT a.vid AS a, a.next_vid AS b, a.edge, a.distance FROM best a JOIN best c ON c.vid = -a.next_vid AND c.next_vid = -a.vid"""
)
def path_links(spark, sf_dir):
    """The links of the first round of the block search, while no edge is used and all votes weigh the same."""
    return search.links(search.open_rows(graph.both_strands(index_of(spark, sf_dir)), None))


@query(
    f"""WITH RECURSIVE {INDEX}, own AS MATERIALIZED (SELECT DISTINCT chr, abs(vid) AS vertex FROM jx), firsts AS MATERIALIZED (SELECT vertex, min(chr) AS low FROM own GROUP BY vertex),
apart AS MATERIALIZED (SELECT DISTINCT low, chr FROM own JOIN firsts USING (vertex) WHERE chr <> low), steps AS MATERIALIZED (SELECT low AS a, chr AS b FROM apart UNION SELECT chr, low FROM apart),
reach(chr, label) AS (SELECT DISTINCT chr, chr FROM own UNION SELECT s.b, r.label FROM reach r JOIN steps s ON s.a = r.chr WHERE r.label < s.b)
SELECT chr, min(label) AS label FROM reach GROUP BY chr"""
)
def components(spark, sf_dir):
    return cc.sequence_components(index_of(spark, sf_dir))


# intervals


def supplier_intervals(spark, sf_dir: str, *more) -> DataFrame:
    """Intervals on suppliers, made of order lines: (chr, start, end), and more columns."""
    return read(spark, sf_dir, "lineitem").select(
        *more, F.col("l_suppkey").alias("chr"), (F.col("l_partkey") * 7 % 5000).alias("start"), (F.col("l_partkey") * 7 % 5000 + F.col("l_quantity").cast("long")).alias("end")
    )


LINES = """ivs AS (SELECT l_suppkey AS chr, l_partkey * 7 % 5000 AS start, l_partkey * 7 % 5000 + l_quantity::BIGINT AS "end" FROM lineitem),
sizes AS (SELECT s_suppkey AS chr, 5100::BIGINT AS size FROM supplier)"""
MERGED = """marked AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT chr, start, max("end") AS "end" FROM ivs WHERE "end" > start GROUP BY chr, start)),
islands AS (SELECT *, sum(CASE WHEN start <= prior THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT chr, min(start) AS start, max("end") AS "end" FROM islands GROUP BY chr, island)"""


def sizes_of(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chr"), F.lit(5100).cast("long").alias("size"))


@query(f'WITH {LINES}, {MERGED} SELECT chr, start, "end" FROM merged')
def covered_runs(spark, sf_dir):
    return intervals.merged(supplier_intervals(spark, sf_dir))


@query(
    f'WITH {LINES}, {MERGED}, cut AS (SELECT chr, start, least("end", size) AS "end", size FROM merged JOIN sizes USING (chr) WHERE start < size) '
    'SELECT * FROM (SELECT chr, coalesce(lag("end") OVER (PARTITION BY chr ORDER BY start), 0) AS start, start AS "end" FROM cut UNION ALL '
    'SELECT sizes.chr, coalesce(max("end"), 0), any_value(sizes.size) FROM sizes LEFT JOIN cut USING (chr) GROUP BY sizes.chr) WHERE "end" > start'
)
def uncovered_runs(spark, sf_dir):
    return intervals.uncovered(sizes_of(spark, sf_dir), supplier_intervals(spark, sf_dir))


@query(f'WITH {LINES}, {MERGED} SELECT (SELECT sum("end" - start)::BIGINT FROM merged) AS covered, (SELECT sum(size)::BIGINT FROM sizes) AS bases, round((SELECT sum("end" - start) FROM merged) / (SELECT sum(size) FROM sizes), 9) AS coverage')
def interval_coverage(spark, sf_dir):
    found = intervals.coverage(intervals.merged(supplier_intervals(spark, sf_dir)), sizes_of(spark, sf_dir))
    return found.select("covered", "bases", F.round("coverage", 9).alias("coverage"))


PARTS = """points AS (SELECT l_suppkey AS chr, l_orderkey AS id, l_linenumber AS line, l_partkey * 11 % 5000 AS pos FROM lineitem),
windows AS (SELECT s_suppkey AS chr, k AS no, k * 500 + s_suppkey % 100 AS start, k * 500 + s_suppkey % 100 + 200 AS "end" FROM supplier, range(0, 10) t(k))"""


def points_of(spark, sf_dir: str) -> DataFrame:
    """Every order line as a point (chr, id, line, pos)."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") * 11 % 5000).alias("pos"))


def windows_of(spark, sf_dir: str) -> DataFrame:
    k = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chr"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("no"))
    start = F.col("no") * 500 + F.col("chr") % 100
    return k.select("chr", "no", start.alias("start"), (start + 200).alias("end"))


@query(f'WITH {PARTS} SELECT p.chr, id, line, pos, no, start, "end" FROM points p JOIN windows w ON p.chr = w.chr AND pos >= start AND pos < "end"')
def interval_containment(spark, sf_dir):
    return intervals.containing(points_of(spark, sf_dir), windows_of(spark, sf_dir))


@query(f'WITH {PARTS} SELECT chr, id, line, pos FROM points p WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE p.chr = w.chr AND pos >= start AND pos < "end")')
def interval_anti(spark, sf_dir):
    return intervals.outside(points_of(spark, sf_dir), windows_of(spark, sf_dir))


@query(
    "SELECT event_id, chr, moment, click FROM (SELECT event_id, user_id AS chr, epoch_us(ts) AS moment, event_type, "
    "max(CASE WHEN event_type = 'click' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS click FROM events) WHERE event_type = 'purchase'"
)
def nearest_instance(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("chr"), F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"), "event_type")
    buys = rows.where("event_type = 'purchase'").drop("event_type")
    clicks = rows.where("event_type = 'click'").select("chr", "moment", F.col("moment").alias("click"))
    return intervals.asof(buys, clicks, "chr", "moment", "click", width=3_600_000_000)


@query("SELECT user_id AS chr, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events")
def event_steps(spark, sf_dir):
    """Ordinals and next events within an hour, shifted by the counts of a user's earlier hours, so that no history is sorted whole."""
    rows = event_sequences(read(spark, sf_dir, "events")).select("chr", "event_id", "ts")
    hour = F.coalesce(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000), F.lit(-(1 << 62)))
    rows = rows.withColumn("hour", hour)
    here = Window.partitionBy("chr", "hour").orderBy("ts", "event_id")
    own = rows.select("chr", "hour", "event_id", F.row_number().over(here).alias("own"), F.lead("event_id").over(here).alias("near"))
    counts = rows.groupBy("chr", "hour").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    hours = Window.partitionBy("chr").orderBy("hour")
    before = F.coalesce(F.sum("n").over(hours.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("chr").alias("user"), F.col("hour").alias("at"), "n", before.alias("before"), F.lead(F.col("first.event_id")).over(hours).alias("far"))
    both = own.join(shifts, F.col("chr").eqNullSafe(F.col("user")) & (F.col("hour") == F.col("at")))
    return both.select("chr", "event_id", (F.col("before") + F.col("own") - 1).cast("long").alias("idx"), F.when(F.col("own") == F.col("n"), F.col("far")).otherwise(F.col("near")).alias("next_id"))


@query(
    "SELECT event_id, user_id AS chr, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) "
    "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS bought FROM events"
)
def used_prefix(spark, sf_dir):
    """How many purchases a user made before each event: the prefix sum by which used edges are counted."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("chr"), F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"), (F.col("event_type") == "purchase").cast("int").alias("buys"))
    return intervals.running(rows, "chr", "moment", "buys", "bought", width=3_600_000_000).select("event_id", "chr", "bought")


@query(
    'WITH copies AS (SELECT l_suppkey AS chr, l_orderkey * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) AS v, l_partkey * 7 % 5000 AS start, l_partkey * 7 % 5000 + l_quantity::BIGINT AS "end" FROM lineitem), '
    'pairs AS (SELECT v AS a, lead(v) OVER w AS b, chr, lead(start) OVER w - "end" AS gap FROM copies WINDOW w AS (PARTITION BY chr ORDER BY start, "end", v)) '
    "SELECT a, b, chr, gap FROM pairs WHERE b IS NOT NULL AND gap <= 3"
)
def block_neighbours(spark, sf_dir):
    """Order lines as copies of blocks: signed neighbours on each supplier, the edges of the block graph."""
    strand = F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-")
    return synteny.neighbours(supplier_intervals(spark, sf_dir, F.col("l_orderkey").alias("block_id"), strand.alias("strand")), 3)


from loomline.plans import block_queries  # noqa: E402, F401  registers the queries of blocks and formats


# cursors and position sets


@query(
    f"WITH {INDEX}, turns AS (SELECT *, count(*) OVER (PARTITION BY chr) AS n, lead(vid, 3) OVER w AS vid_on, lead(pos, 3) OVER w AS pos_on, lag(vid, 3) OVER w AS vid_back, lag(pos, 3) OVER w AS pos_back "
    "FROM jx WINDOW w AS (PARTITION BY chr ORDER BY idx)) SELECT chr, idx, 1 AS strand, idx AS nth, vid_on AS to_vid, pos_on AS to_pos FROM turns "
    "UNION ALL SELECT chr, idx, -1, n - idx - 1, -vid_back, pos_back FROM turns"
)
def cursor_advance(spark, sf_dir):
    occurrences = graph.relative_index(graph.both_strands(index_of(spark, sf_dir)).drop("ch"))
    return graph.advanced(checkpointed(occurrences), 3).select("chr", "idx", "strand", "nth", "to_vid", "to_pos")


@query(f"WITH {INDEX} SELECT chr, pos // {graph.STRETCH} AS stretch, string_agg(DISTINCT pos::VARCHAR, ',' ORDER BY pos::VARCHAR) AS positions FROM jx GROUP BY 1, 2")
def junction_positions(spark, sf_dir):
    sets = graph.position_sets(index_of(spark, sf_dir))
    return sets.select("chr", "stretch", F.array_join(F.array_sort(F.col("positions").cast("array<string>")), ",").alias("positions"))
