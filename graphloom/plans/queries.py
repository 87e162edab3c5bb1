"""The registered queries over the derived graphs, each with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import codec_size as cs
from graphloom.functions import codecs
from graphloom.functions import list_codecs as lists_of
from graphloom.functions import sequence as sq
from graphloom.operators import algorithms as al
from graphloom.operators import analytics as an
from graphloom.operators import elements as el
from graphloom.operators import graph as gr
from graphloom.operators import reports as rp
from graphloom.plans import derive
from graphloom.plans.tables import cut, noted, shared_dir
from graphloom.sources import block_file, gfa_text
from graphloom.sources.gfa_text import canonical

BASE = """
items AS (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, l_linestatus, row_number() OVER w AS rn, lead(l_partkey) OVER w AS next_part, lead(l_linestatus) OVER w AS next_status
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)),
d_segments AS (SELECT p_partkey AS ord, 'p'||p_partkey AS name, CASE WHEN p_partkey % 10 = 0 THEN '*' ELSE translate(md5(CAST(p_partkey AS VARCHAR)),'0123456789abcdef','ACGTACGTACGTACGT') END AS sequence, p_size AS rc FROM part),
d_fasta AS (SELECT 'p'||p_partkey AS id, translate(md5(CAST(p_partkey AS VARCHAR)),'0123456789abcdef','ACGTACGTACGTACGT') AS sequence FROM part WHERE p_partkey % 20 = 0),
d_links AS (SELECT l_orderkey*1000+rn AS ord, 'e'||(l_orderkey*1000+rn) AS eid, 'p'||l_partkey AS from_node, CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END AS from_orn, 'p'||next_part AS to_node, CASE WHEN l_linestatus='F' THEN '-' ELSE '+' END AS to_orn,
  CASE WHEN rn % 7 = 0 THEN '*' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR)||'M' END AS alignment FROM items WHERE next_part IS NOT NULL),
d_paths AS (SELECT 'o'||l_orderkey AS path_name, count(*) AS n, string_agg('p'||l_partkey||CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END, ',' ORDER BY rn) AS steps FROM items GROUP BY l_orderkey),
d_walks AS (SELECT 'u'||user_id AS sample_id, user_id % 2 AS hapindex, event_type AS seq_id, min(event_id) AS seq_start, max(event_id) AS seq_end, count(*) AS n,
  string_agg(CASE WHEN event_id % 2 = 0 THEN '>' ELSE '<' END||'p'||coalesce(json_extract_string(props,'$.k'),'0'), '' ORDER BY event_id) AS walk FROM events GROUP BY user_id, event_type, event_id // 1000),
c_segments AS (SELECT l_orderkey, rn, l_orderkey*1000+rn AS ord, 'o'||l_orderkey||'.'||rn AS name, left(translate(md5(CAST(l_orderkey*1000+rn AS VARCHAR)),'0123456789abcdef','ACGTACGTACGTACGT'),12) AS sequence, l_linestatus, CAST(l_quantity AS INT) % 5 AS k FROM items),
c_islands AS (SELECT *, rn - row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY rn) AS isl, lag(k) OVER (PARTITION BY l_orderkey ORDER BY rn) AS pk FROM c_segments),
c_chains AS (SELECT *, min(rn) OVER (PARTITION BY l_orderkey, l_linestatus, isl) AS first_rn FROM c_islands)"""


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([BASE.strip(), *more])}\n{body}"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(oracle: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


SEQ_STATS = """SELECT coalesce(round(avg(length(sequence)),2),0.0) AS avg_seq_len, CAST(coalesce(max(length(sequence)),0) AS BIGINT) AS max_seq_len,
 coalesce(round(CAST(sum(length(sequence)-length(replace(replace(sequence,'G',''),'C',''))) AS DOUBLE)/sum(length(sequence)),4),0.0) AS gc_content FROM d_segments WHERE sequence<>'*'"""
COUNTS = "SELECT (SELECT count(*) FROM d_segments) AS n_segments, (SELECT count(*) FROM d_links) AS n_links, (SELECT count(*) FROM d_paths) AS n_paths, (SELECT count(*) FROM d_walks) AS n_walks"
ALPHABET = """SELECT (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(sequence,'')) AS c FROM d_segments WHERE sequence<>'*') WHERE c<>'') AS unique_chars_seq,
 (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(x,'')) AS c FROM (SELECT name AS x FROM d_segments UNION ALL SELECT eid FROM d_links UNION ALL SELECT path_name FROM d_paths)) WHERE c<>'') AS unique_chars_names"""
CIGARS = "SELECT coalesce(round(avg(length(alignment)) FILTER (alignment<>'*'),2),0.0) AS avg_cigar_len, coalesce(round(avg(CASE WHEN alignment<>'*' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),4),0.0) AS cigar_present_ratio FROM d_links"
DEPTH = "SELECT round(avg(n),2) AS avg_path_depth, max(n) AS max_path_depth FROM d_paths"


@register(sql(f"SELECT * FROM ({COUNTS}), ({SEQ_STATS}), ({ALPHABET}), ({CIGARS}), ({DEPTH})"))
def characterise(spark, d):
    return an.characterise(derive.graph(spark, d))


@register(sql(COUNTS))
def graph_counts(spark, d):
    return gr.counts(derive.graph(spark, d))


@register(sql(SEQ_STATS))
def sequence_stats(spark, d):
    return an.sequence_stats(derive.segments(spark, d))


@register(sql(ALPHABET))
def char_alphabet(spark, d):
    return an.alphabet(derive.graph(spark, d))


@register(sql(CIGARS))
def cigar_stats(spark, d):
    return an.cigar_stats(derive.links(spark, d))


@register(sql(DEPTH))
def path_depth(spark, d):
    return an.path_depth(derive.paths(spark, d))


@register(sql("SELECT node, side, count(*) AS degree FROM (SELECT from_node AS node, CASE WHEN from_orn='+' THEN 'R' ELSE 'L' END AS side FROM d_links UNION ALL SELECT to_node, CASE WHEN to_orn='+' THEN 'L' ELSE 'R' END FROM d_links) GROUP BY ALL"))
def degree_by_end(spark, d):
    return gr.degrees(derive.links(spark, d))


def _large(spark, d):
    """The graph whose segments are the parts of size 10 and more; links keep all their ends."""
    g = derive.graph(spark, d)
    return gr.replace(g, segments=g.segments.filter(F.element_at("tags", "RC")["value"].cast("int") >= 10))


@register(sql("SELECT DISTINCT x AS name FROM (SELECT from_node AS x FROM d_links UNION ALL SELECT to_node FROM d_links) WHERE x NOT IN (SELECT name FROM d_segments WHERE rc >= 10)"))
def implicit_nodes(spark, d):
    return gr.implicit_nodes(_large(spark, d))


@register(sql("SELECT eid FROM d_links WHERE from_node NOT IN (SELECT name FROM d_segments WHERE rc >= 10) OR to_node NOT IN (SELECT name FROM d_segments WHERE rc >= 10)"))
def dangling_links(spark, d):
    return gr.dangling_links(_large(spark, d)).select("eid")


@register(sql("SELECT 'node' AS kind, name AS id FROM d_segments WHERE rc > 25 AND sequence LIKE '%ACG%' UNION ALL SELECT 'edge', eid FROM d_links WHERE from_orn='-' AND alignment='*' UNION ALL SELECT 'path', path_name FROM d_paths WHERE n > 5 UNION ALL SELECT 'walk', sample_id||'_'||hapindex||'_'||seq_id||'_'||seq_start||'_'||seq_end FROM d_walks WHERE n > 3"))
def search_union(spark, d):
    return gr.search(derive.graph(spark, d), node="cast(element_at(tags, 'RC').value as int) > 25 and sequence like '%ACG%'", edge="from_orn = '-' and alignment = '*'", path="size(steps) > 5", walk="size(steps) > 3")


@register(sql("SELECT kind, count(*) AS n FROM (SELECT 'node' AS kind FROM d_segments UNION ALL SELECT 'edge' FROM d_links UNION ALL SELECT 'path' FROM d_paths UNION ALL SELECT 'walk' FROM d_walks) GROUP BY kind"))
def get_by_id_precedence(spark, d):
    g = derive.graph(spark, d)
    return gr.get_by_id(g, gr.elements(g)).groupBy("kind").agg(F.count("*").alias("n"))


@register(sql("SELECT l.eid FROM d_links l JOIN (SELECT least(from_node,to_node) AS a, greatest(from_node,to_node) AS b FROM d_links ORDER BY ord LIMIT 1) x ON least(from_node,to_node)=a AND greatest(from_node,to_node)=b"))
def edge_pair_lookup(spark, d):
    links = derive.links(spark, d)
    first = links.orderBy("ord").limit(1).first()
    return (gr.edges_between(links, first["from_node"], first["to_node"]) if first else links).select("eid")


@register(sql("SELECT node, count(DISTINCT other) AS n FROM (SELECT from_node AS node, to_node AS other FROM d_links UNION ALL SELECT to_node, from_node FROM d_links) GROUP BY node"))
def neighbours(spark, d):
    return gr.neighbours(derive.links(spark, d)).groupBy("node").agg(F.count("*").alias("n"))


@register(sql("SELECT eid FROM d_links WHERE from_node IN (SELECT name FROM d_segments WHERE rc >= 30) AND to_node IN (SELECT name FROM d_segments WHERE rc >= 30)"))
def induced_subgraph(spark, d):
    g = derive.graph(spark, d)
    return gr.induced(g, g.segments.filter("cast(element_at(tags, 'RC').value as int) >= 30")).links.select("eid")


@register(sql("SELECT name, CASE WHEN rc > 25 THEN 'ACGT' ELSE sequence END AS sequence, CASE WHEN sequence<>'*' THEN length(sequence) END AS slen FROM d_segments"))
def upsert_last_wins(spark, d):
    s = derive.segments(spark, d)
    new = s.filter("cast(element_at(tags, 'RC').value as int) > 25").withColumns({"sequence": F.lit("ACGT"), "slen": F.lit(None).cast("bigint")})
    return gr.upsert(s, new, "name").select("name", "sequence", "slen")


@register(sql("SELECT ord, CASE WHEN alignment='*' THEN 'virtual_'||(row_number() OVER (PARTITION BY alignment='*' ORDER BY ord)-1) ELSE eid END AS eid FROM d_links"))
def virtual_ids(spark, d):
    links = derive.links(spark, d)
    return gr.named_links(links.withColumn("eid", F.when(F.col("alignment") != "*", F.col("eid")))).select("ord", "eid")


@register(sql("SELECT eid FROM d_links WHERE from_node NOT IN (SELECT name FROM d_segments WHERE rc < 10) AND to_node NOT IN (SELECT name FROM d_segments WHERE rc < 10)"))
def remove_node_cascade(spark, d):
    g = derive.graph(spark, d)
    return gr.remove_nodes(g, g.segments.filter("cast(element_at(tags, 'RC').value as int) < 10")).links.select("eid")


@register(sql("""SELECT 1 AS section, 'S'||chr(9)||name||chr(9)||sequence||chr(9)||'RC:i:'||rc AS line FROM d_segments
 UNION ALL SELECT 2, concat_ws(chr(9),'L',from_node,from_orn,to_node,to_orn,alignment) FROM d_links
 UNION ALL SELECT 4, concat_ws(chr(9),'P',path_name,steps,'*') FROM d_paths
 UNION ALL SELECT 5, concat_ws(chr(9),'W',sample_id,CAST(hapindex AS VARCHAR),seq_id,CAST(seq_start AS VARCHAR),CAST(seq_end AS VARCHAR),walk) FROM d_walks"""))
def to_text_lines(spark, d):
    return canonical(derive.graph(spark, d)).select("section", "line")


OVERLAP = """x AS (SELECT l.*, {a} AS a0, {b} AS b0, TRY_CAST(nullif(regexp_extract(alignment,'^([0-9]+)M$',1),'') AS INT) AS declared FROM d_links l JOIN d_segments s ON s.name=l.from_node JOIN d_segments t ON t.name=l.to_node{joins}),
y AS (SELECT eid, declared, CASE WHEN from_orn='-' THEN reverse(translate(a0,'ACGT','TGCA')) ELSE a0 END AS a, CASE WHEN to_orn='-' THEN reverse(translate(b0,'ACGT','TGCA')) ELSE b0 END AS b FROM x),
z AS (SELECT eid, declared, CASE WHEN declared IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL THEN coalesce(list_max(list_filter(range(1, least(length(a),length(b))+1), lambda i: right(a,i)=left(b,i))),0) END AS real FROM y)"""
OVERLAP_OUT = "SELECT eid, declared, CAST(real AS INT) AS real, CASE WHEN real IS NULL THEN 'not computable' WHEN real=declared THEN 'consistent' ELSE 'inconsistent' END AS status FROM z"


@register(sql(OVERLAP_OUT, OVERLAP.format(a="nullif(s.sequence,'*')", b="nullif(t.sequence,'*')", joins="")))
def overlap_check(spark, d):
    return al.overlap_check(derive.graph(spark, d)).select("eid", "declared", "real", "status")


@register(sql(OVERLAP_OUT, OVERLAP.format(a="coalesce(nullif(s.sequence,'*'),f.sequence)", b="coalesce(nullif(t.sequence,'*'),h.sequence)", joins=" LEFT JOIN d_fasta f ON f.id=s.name LEFT JOIN d_fasta h ON h.id=t.name")))
def overlap_check_fasta(spark, d):
    return al.overlap_check(derive.graph(spark, d), derive.fasta(spark, d)).select("eid", "declared", "real", "status")


@register(sql("""SELECT side, from_node, to_node, alignment FROM (SELECT 'left' AS side, * FROM (SELECT from_node,from_orn,to_node,to_orn,alignment FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT from_node,from_orn,to_node,to_orn,alignment FROM a))""", "a AS (SELECT from_node,from_orn,to_node,to_orn,alignment FROM d_links)", "b AS (SELECT from_node, from_orn, to_node, to_orn, CASE WHEN alignment='*' THEN '0M' ELSE alignment END AS alignment FROM d_links)"))
def link_set_diff(spark, d):
    links = derive.links(spark, d)
    other = links.withColumn("alignment", F.when(F.col("alignment") == "*", "0M").otherwise(F.col("alignment")))
    return gr.link_difference(links, other).select("side", "from_node", "to_node", "alignment")


@register(sql("SELECT name AS node, min(name) OVER (PARTITION BY l_orderkey, l_linestatus, isl) AS component FROM c_islands"))
def components(spark, d):
    return al.components(derive.chain_graph(spark, d))


@register(sql("SELECT name AS node FROM c_chains WHERE (l_orderkey, l_linestatus, isl) = (SELECT (l_orderkey, l_linestatus, isl) FROM c_chains ORDER BY ord LIMIT 1)"))
def component_of(spark, d):
    g = derive.chain_graph(spark, d)
    return al.component_of(g, g.segments.orderBy("ord").limit(1).first()["name"])


@register(sql("""SELECT a.from_node||'>'||a.to_node AS nodes, a.eid AS eids FROM e a JOIN q ON a.from_node=q.s AND a.to_node=q.t WHERE q.s<>q.t
 UNION ALL SELECT a.from_node||'>'||a.to_node||'>'||b.to_node, a.eid||','||b.eid FROM e a JOIN e b ON a.to_node=b.from_node JOIN q ON a.from_node=q.s AND b.to_node=q.t WHERE a.to_node<>q.t AND a.to_node<>q.s AND q.s<>q.t""",
 "e AS (SELECT * FROM d_links WHERE alignment<>'*')", "q AS (SELECT from_node AS s, to_node AS t FROM e ORDER BY ord LIMIT 1)"))
def simple_paths(spark, d):
    links = derive.links(spark, d).filter("alignment <> '*'")
    first = links.orderBy("ord").limit(1).first()
    return al.simple_paths(links, first["from_node"], first["to_node"], 2).select(F.array_join("nodes", ">").alias("nodes"), F.array_join("eids", ",").alias("eids"))


@register(sql("SELECT 'e'||l.ord AS eid FROM c_segments l JOIN c_segments r ON r.l_orderkey=l.l_orderkey AND r.rn=l.rn+1 AND r.l_linestatus=l.l_linestatus"))
def unary_edges(spark, d):
    return al.unary_links(derive.chain_graph(spark, d).links).select("eid")


@register(sql("SELECT 'o'||l_orderkey||'.'||first_rn AS name, count(*) AS n_members, string_agg(name, ',' ORDER BY rn) AS members, string_agg(CASE WHEN rn=first_rn THEN sequence ELSE substr(sequence, pk+1) END, '' ORDER BY rn) AS sequence, CAST(sum(12-CASE WHEN rn=first_rn THEN 0 ELSE pk END) AS BIGINT) AS slen FROM c_chains GROUP BY l_orderkey, l_linestatus, isl, first_rn"))
def compaction(spark, d):
    segments, _ = al.compact(derive.chain_graph(spark, d))
    return segments.select("name", F.size("members").cast("bigint").alias("n_members"), F.array_join("members", ",").alias("members"), "sequence", "slen")


def _events(spark, d):
    return derive.load(spark, d, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


EV = "ev AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)"


@register(f"WITH {EV} SELECT event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id),0) AS delta FROM ev")
def delta_encode(spark, d):
    return an.delta_encode(_events(spark, d), "user_id", "event_id", "event_id").select("event_id", "delta")


@register(f"WITH {EV} SELECT event_id, event_id AS decoded FROM ev")
def delta_decode(spark, d):
    return an.delta_decode(an.delta_encode(_events(spark, d), "user_id", "event_id", "event_id"), "user_id", "event_id").select("event_id", "decoded")


@register(f"""WITH {EV}, o AS (SELECT *, k - min(k) OVER (PARTITION BY user_id) AS off, count(*) OVER (PARTITION BY user_id) AS n FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off) AS i FROM o),
 t AS (SELECT *, greatest(1, max(CASE WHEN i = (n*95)//100+1 THEN off END) OVER (PARTITION BY user_id)) AS threshold FROM r) SELECT event_id, off AS "offset", threshold, off > threshold AS outlier FROM t""")
def pfor_split(spark, d):
    return an.frame_split(_events(spark, d), "user_id", "k").select("event_id", "offset", F.col("threshold").cast("bigint").alias("threshold"), "outlier")


@register(f"WITH {EV}, f AS (SELECT user_id, event_type, min(event_id) AS m FROM ev GROUP BY ALL) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY m, event_type)-1 AS code FROM f")
def dictionary_index(spark, d):
    return an.dictionary(_events(spark, d), "user_id", "event_id", "event_type").select("user_id", "event_type", F.col("code").cast("bigint").alias("code"))


@register(f"WITH {EV}, a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS value, count(*) AS length, count(*)>=3 AS packed FROM b GROUP BY user_id, run")
def rle_runs(spark, d):
    return an.runs(_events(spark, d), "user_id", "event_id", "event_type")


@register(f"WITH {EV} SELECT user_id, block, count(*) AS n FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1)//16 AS block FROM ev) GROUP BY ALL")
def block_assignment(spark, d):
    return an.blocks(_events(spark, d), "user_id", "event_id", 16).groupBy("user_id", "block").agg(F.count("*").alias("n"))


BL = "(CASE WHEN {x} > 0 THEN length(bin({x})) ELSE 0 END)"


def _bl(x: str) -> str:
    return BL.format(x=x)


@register(f"""WITH v AS (SELECT l_partkey AS x FROM lineitem) SELECT CAST(sum(length(CAST(x AS VARCHAR))+1) AS BIGINT) AS ascii_size, CAST(sum(greatest(1,ceil({_bl('x')}/7.0))) AS BIGINT) AS varint_size, count(*)*4 AS fixed32_size,
 CAST(ceil(sum(2*({_bl('(x+1)')}-1)+1)/8.0) AS BIGINT) AS gamma_size, CAST(1+ceil(sum((x>>4)+5)/8.0) AS BIGINT) AS rice_size, CAST(4+ceil(count(*)/4.0)+sum(CASE WHEN x<256 THEN 1 WHEN x<65536 THEN 2 WHEN x<16777216 THEN 3 ELSE 4 END) AS BIGINT) AS group_varint_size,
 CAST(5+count(*)*greatest(1,ceil(least(max({_bl('x')}),32)/8.0)) AS BIGINT) AS bit_packing_size, CAST(5+count(*)*CASE WHEN max(x)<256 THEN 1 WHEN max(x)<65536 THEN 2 WHEN max(x)<4294967296 THEN 4 ELSE 8 END AS BIGINT) AS byte_packed_size, CAST(4+sum(1+greatest(1,ceil({_bl('x')}/7.0))) AS BIGINT) AS fibonacci_size FROM v""")
def integer_codec_sizes(spark, d):
    x = F.col("l_partkey")
    parts = {"ascii": cs.ascii_size, "varint": cs.varint_size, "fixed32": cs.SIZES["fixed32"], "gamma": cs.gamma_size, "rice": cs.rice_size, "group_varint": cs.group_varint_size, "bit_packing": cs.bit_packing_size, "byte_packed": cs.byte_packed_size, "fibonacci": cs.length_prefixed_size}
    return derive.load(spark, d, "lineitem").agg(*[f(x).alias(f"{k}_size") for k, f in parts.items()])


@register(sql("SELECT CAST(sum(ceil(length(sequence)/4.0)) AS BIGINT) AS two_bit_size FROM d_segments WHERE sequence<>'*'"))
def two_bit_size(spark, d):
    return derive.segments(spark, d).filter("sequence <> '*'").agg(cs.two_bit_size(F.col("sequence")).alias("two_bit_size"))


STATS = """st AS (SELECT l_linestatus AS o, 'c'||(CAST(l_quantity AS INT)%10) AS v, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS DOUBLE) AS u, CAST(l_partkey+100 AS DOUBLE) AS c, l_discount*10 AS e, l_tax*10 AS dd, l_returnflag AS ds FROM lineitem),
rk AS (SELECT o AS compression_option, v AS compression_value, avg(u/c) AS ratio_mean, quantile_cont(u/c,0.5) AS ratio_median, min(u/c) AS ratio_min, max(u/c) AS ratio_max, coalesce(avg(e) FILTER (e>0),0.0) AS encode_ms, coalesce(avg(dd) FILTER (dd>0),0.0) AS decode_ms, avg(CASE WHEN e+dd>0 THEN u/((e+dd)/1000.0) END) AS throughput, count(DISTINCT ds) AS datasets FROM st GROUP BY o, v)"""


@register(f"WITH {STATS} SELECT compression_option, compression_value, round(ratio_mean,6) AS ratio_mean, round(ratio_median,6) AS ratio_median, round(ratio_min,6) AS ratio_min, round(ratio_max,6) AS ratio_max, round(encode_ms,6) AS encode_ms, round(decode_ms,6) AS decode_ms, round(throughput,3) AS throughput, datasets FROM rk")
def codec_rank(spark, d):
    r = an.ranking(derive.codec_stats(spark, d))
    return r.select("compression_option", "compression_value", *[F.round(c, 6).alias(c) for c in ("ratio_mean", "ratio_median", "ratio_min", "ratio_max", "encode_ms", "decode_ms")], F.round("throughput", 3).alias("throughput"), "datasets")


@register(f"WITH {STATS} SELECT compression_option, compression_value FROM rk a WHERE NOT EXISTS (SELECT 1 FROM rk b WHERE a.compression_option=b.compression_option AND b.ratio_mean>=a.ratio_mean AND b.decode_ms<=a.decode_ms AND (b.ratio_mean>a.ratio_mean OR b.decode_ms<a.decode_ms))")
def pareto(spark, d):
    return an.pareto(an.ranking(derive.codec_stats(spark, d))).select("compression_option", "compression_value")


@register(f"WITH {STATS}, s AS (SELECT *, ratio_mean*(1+ln(throughput/max(throughput) OVER (PARTITION BY compression_option))) AS score FROM rk), t AS (SELECT *, row_number() OVER (PARTITION BY compression_option ORDER BY score DESC, compression_value) AS rank FROM s) SELECT compression_option, compression_value, round(score,5) AS score, CAST(rank AS INT) AS rank FROM t WHERE rank<=5")
def balanced_score(spark, d):
    return an.top(an.ranking(derive.codec_stats(spark, d)), "balanced", 5).select("compression_option", "compression_value", F.round("score", 5).alias("score"), "rank")


@register("""WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice)-1 AS i, count(*) OVER () AS n FROM orders), q AS (SELECT max(CASE WHEN i=n//4 THEN v END) AS a, max(CASE WHEN i=n*2//4 THEN v END) AS b, max(CASE WHEN i=n*3//4 THEN v END) AS c FROM s)
 SELECT CASE WHEN o_totalprice<=a THEN 'q1' WHEN o_totalprice<=b THEN 'q2' WHEN o_totalprice<=c THEN 'q3' ELSE 'q4' END AS bucket, count(*) AS n FROM orders, q GROUP BY 1""")
def quartile_buckets(spark, d):
    return an.quartiles(derive.load(spark, d, "orders").select("o_totalprice"), "o_totalprice").groupBy("bucket").agg(F.count("*").alias("n"))


@register(f"WITH {EV}, f AS (SELECT user_id, avg(k) AS mean, stddev_pop(k) AS std, max(k) AS largest FROM ev GROUP BY user_id) SELECT user_id, round(mean,6) AS mean, round(std,6) AS std, largest, CASE WHEN std>0 AND largest>mean+10*std THEN 'pfor_delta' WHEN largest<65536 THEN 'bit_packing' ELSE 'varint' END AS suggested FROM f")
def heuristic_features(spark, d):
    return an.heuristic_features(_events(spark, d), "user_id", "k").select("user_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "largest", "suggested")


@register(sql("SELECT name, CASE WHEN sequence='*' THEN '*' ELSE reverse(translate(sequence,'ACGT','TGCA')) END AS rc FROM d_segments"))
def revcomp(spark, d):
    return derive.segments(spark, d).select("name", sq.reverse_complement(F.col("sequence")).alias("rc"))


@register(sql("SELECT eid, CASE WHEN alignment='*' THEN 0 ELSE CAST(replace(alignment,'M','') AS BIGINT) END AS n, CASE WHEN alignment='*' THEN '' ELSE 'M' END AS ops FROM d_links"))
def cigar_parse(spark, d):
    parsed = sq.cigar_parse(F.col("alignment"))
    return derive.links(spark, d).select("eid", F.aggregate(parsed, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n"), F.array_join(F.transform(parsed, lambda x: x["op"]), "").alias("ops"))


@register(sql("SELECT name, 'i' AS type, rc AS value FROM d_segments"))
def tag_parse(spark, d):
    fields = F.array(F.concat(F.lit("RC:i:"), F.element_at("tags", "RC")["value"]), F.lit("bad"))
    return derive.segments(spark, d).select("name", sq.tags_of(fields).alias("t")).select("name", F.element_at("t", "RC")["type"].alias("type"), F.element_at("t", "RC")["value"].cast("int").alias("value"))


@register(sql("SELECT sample_id, seq_id, seq_start, n, walk FROM d_walks"))
def walk_parse(spark, d):
    w = derive.walks(spark, d)
    text = F.array_join(F.transform("steps", lambda s: F.concat(F.when(s["orn"] == "-", "<").otherwise(">"), s["seg"])), "")
    parsed = sq.steps_of(text)
    back = F.array_join(F.transform(parsed, lambda s: F.concat(F.when(s["orn"] == "-", "<").otherwise(">"), s["seg"])), "")
    return w.select("sample_id", "seq_id", "seq_start", F.size(parsed).cast("bigint").alias("n"), back.alias("walk"))


_ROUND = """k{i} AS (SELECT c.node, md5(c.colour||'/'||coalesce(string_agg(x, ',' ORDER BY x),'')) AS colour FROM k{j} c LEFT JOIN (SELECT from_node AS node, concat_ws(':','o',from_orn,to_orn,alignment,colour) AS x FROM d_links JOIN k{j} ON node=to_node
 UNION ALL SELECT to_node, concat_ws(':','i',from_orn,to_orn,alignment,colour) FROM d_links JOIN k{j} ON node=from_node) y ON y.node=c.node GROUP BY c.node, c.colour)"""


@register(sql("SELECT n, count(*) AS classes FROM (SELECT count(*) AS n FROM k3 GROUP BY colour) GROUP BY n", "k0 AS (SELECT name AS node, md5(sequence) AS colour FROM d_segments)", *[_ROUND.format(i=i, j=i - 1) for i in (1, 2, 3)]))
def wl_colours(spark, d):
    """How many classes of nodes have each size after three rounds; colours themselves are hashes of our own."""
    return al.colours(derive.graph(spark, d)).groupBy("n").agg(F.count("*").alias("classes"))


@register(sql("""SELECT component, CAST(CASE WHEN rn > r THEN rn-r-1 + CASE WHEN up THEN 0 ELSE r-a END ELSE r-rn-1 + CASE WHEN up THEN b-r ELSE 0 END END AS BIGINT) AS position,
 'o'||l_orderkey||'.'||CASE WHEN rn > r THEN rn-1 ELSE rn+1 END AS u, name AS v, 'e'||CASE WHEN rn > r THEN ord-1 ELSE ord END AS eid FROM c_chains JOIN roots USING (l_orderkey, l_linestatus, isl) WHERE rn <> r""",
 "least AS (SELECT l_orderkey, l_linestatus, isl, min(name) AS component, arg_min(rn, name) AS r, min(rn) AS a, max(rn) AS b FROM c_chains GROUP BY ALL)",
 "roots AS (SELECT *, r < b AND (r = a OR 'o'||l_orderkey||'.'||(r+1) < 'o'||l_orderkey||'.'||(r-1)) AS up FROM least)"))
def dfs_edges(spark, d):
    return al.dfs_edges(derive.chain_graph(spark, d))


def _block_file(spark, d) -> str:
    """The derived graph as a block file in the shared folder."""
    path = noted(f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}.bin")
    block_file.write(derive.graph(spark, d), path, block_size=8192)
    noted(path + ".blocks")
    return path


@register(sql("""SELECT 1 AS section, concat_ws(chr(9),'S',name,sequence,'RC:i:'||rc) AS line FROM d_segments
 UNION ALL SELECT 2, concat_ws(chr(9),'L',from_node,from_orn,to_node,to_orn,alignment,'ID:Z:'||eid) FROM d_links
 UNION ALL SELECT 4, concat_ws(chr(9),'P',path_name,steps,'*') FROM d_paths
 UNION ALL SELECT 5, concat_ws(chr(9),'W',sample_id,CAST(hapindex AS VARCHAR),seq_id,CAST(seq_start AS VARCHAR),CAST(seq_end AS VARCHAR),walk) FROM d_walks"""))
def block_file_round_trip(spark, d):
    return canonical(block_file.read(spark, _block_file(spark, d))).select("section", "line")


@register(sql("""SELECT 'segments' AS section_type, 'names' AS section_field, count(*) AS records, CAST(sum(length(name)) AS BIGINT) AS raw FROM d_segments
 UNION ALL SELECT 'segments', 'sequences', count(*), CAST(sum(CASE WHEN sequence='*' THEN 0 ELSE length(sequence) END) AS BIGINT) FROM d_segments
 UNION ALL SELECT 'links', 'fromto', count(*), 32*count(*) FROM d_links UNION ALL SELECT 'links', 'cigars', count(*), CAST(sum(length(alignment)) AS BIGINT) FROM d_links
 UNION ALL SELECT 'paths', 'names', count(*), CAST(sum(length(path_name)) AS BIGINT) FROM d_paths UNION ALL SELECT 'paths', 'cigars', count(*), count(*) FROM d_paths
 UNION ALL SELECT 'paths', 'paths', count(*), CAST(8*(count(*)+2*sum(n)) AS BIGINT) FROM d_paths
 UNION ALL SELECT 'walks', unnest(['samples','haplotypes','sequences','positions','walks']), unnest([n,n,n,n,n]), unnest([a,n,b,2*n,t]) FROM (SELECT count(*) AS n, CAST(sum(length(sample_id)) AS BIGINT) AS a, CAST(sum(length(seq_id)) AS BIGINT) AS b, CAST(sum(n) AS BIGINT) AS t FROM d_walks)
 UNION ALL SELECT 'tags', 'tags', (SELECT count(*) FROM d_segments), CAST((SELECT sum(length('RC:i:'||rc)) FROM d_segments)+(SELECT sum(length('ID:Z:'||eid)) FROM d_links) AS BIGINT)"""))
def block_statistics(spark, d):
    stats = block_file.statistics(spark, _block_file(spark, d))
    return stats.groupBy("section_type", "section_field").agg(F.sum("record_num").alias("records"), F.sum("uncompressed_length").alias("raw"))


@register(f"""WITH v AS (SELECT l_orderkey, l_partkey AS x FROM lineitem) SELECT l_orderkey, count(*) AS n, CAST(sum(greatest(1,ceil({_bl('x')}/7.0))) AS BIGINT) AS varint, CAST(ceil(sum(2*({_bl('(x+1)')}-1)+1)/8.0) AS BIGINT) AS elias_gamma,
 CAST(1+ceil(sum((x>>4)+5)/8.0) AS BIGINT) AS rice, CAST(4+ceil(count(*)/4.0)+sum(CASE WHEN x<256 THEN 1 WHEN x<65536 THEN 2 WHEN x<16777216 THEN 3 ELSE 4 END) AS BIGINT) AS group_varint, true AS same FROM v GROUP BY l_orderkey""")
def codec_bytes(spark, d):
    """Bytes of each order's parts as really encoded, and whether they decode to what they were."""
    lists = derive.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("v"))
    names = ("varint", "elias_gamma", "rice", "group_varint")
    rows = lists.select("l_orderkey", F.size("v").cast("bigint").alias("n"), codecs.round_trips(F.col("v"), *names).alias("t"))
    same = reduce(and_, [F.col("t")[k]["same"] for k in names])
    return rows.select("l_orderkey", "n", *[F.col("t")[k]["size"].alias(k) for k in names], same.alias("same"))


def _folder(spark, name: str) -> str:
    return noted(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


LINES = """SELECT 0 AS section, '' AS k1, '' AS k2, '' AS k3, '' AS k4, '' AS k5, 'H'||chr(9)||'VN:Z:1.0' AS line
 UNION ALL SELECT 1, name, '', '', '', '', 'S'||chr(9)||name||chr(9)||sequence||chr(9)||'RC:i:'||rc FROM d_segments
 UNION ALL SELECT 2, from_node, to_node, from_orn, to_orn, alignment, concat_ws(chr(9),'L',from_node,from_orn,to_node,to_orn,alignment) FROM d_links
 UNION ALL SELECT 4, path_name, '', '', '', '', concat_ws(chr(9),'P',path_name,steps,'*') FROM d_paths
 UNION ALL SELECT 5, sample_id, seq_id, CAST(hapindex AS VARCHAR), CAST(seq_start AS VARCHAR), '', concat_ws(chr(9),'W',sample_id,CAST(hapindex AS VARCHAR),seq_id,CAST(seq_start AS VARCHAR),CAST(seq_end AS VARCHAR),walk) FROM d_walks"""


def _text_folder(spark, d) -> str:
    path = _folder(spark, "text")
    gfa_text.write_text(derive.graph(spark, d), path)
    return path


@register(sql(f"SELECT section, line FROM ({LINES})"))
def text_scan(spark, d):
    """The graph written as text, scanned, and written again."""
    return canonical(gfa_text.scan(spark, _text_folder(spark, d))).select("section", "line")


@register(sql(f"SELECT row_number() OVER (ORDER BY section, k1, k2, k3, k4, k5, line) AS position, line FROM ({LINES})"))
def text_line_order(spark, d):
    """The written lines, numbered as they stand in the files."""
    lines = gfa_text.read_lines(spark, _text_folder(spark, d))
    part = F.shiftright("ord", gfa_text.FILE_BITS)
    rows = lines.withColumn("p", part)
    sums = rows.groupBy("p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("p").orderBy("ord"))
    return rows.withColumn("i", inside).join(sums.select("p", before.alias("b")), "p").select((F.col("b") + F.col("i")).alias("position"), "line")


@register(sql("SELECT id, sequence FROM d_fasta"))
def fasta_scan(spark, d):
    """Sequences over several lines each, read from FASTA text."""
    path = _folder(spark, "fasta")
    wrapped = F.regexp_replace("sequence", "(.{10})", "$1\n")
    derive.fasta(spark, d).select(F.concat(F.lit(">"), "id", F.lit(" of a part\n"), wrapped).alias("line")).write.text(path)
    return gfa_text.read_fasta(spark, path)


@register("SELECT CASE c_custkey % 5 WHEN 1 THEN 'fields of S' WHEN 2 THEN 'record type' WHEN 3 THEN 'fields of L' ELSE 'fields of W' END AS reason, count(*) AS n FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1")
def rejected_lines(spark, d):
    """What the scan rejects, by reason; comments, blank lines and good ones are not among it."""
    k = F.col("c_custkey") % 5
    tab = lambda *x: F.concat_ws("\t", *[F.lit(v) if not isinstance(v, Column) else v for v in x])
    line = F.when(k == 0, tab("S", F.col("c_custkey").cast("string"), "ACGT")).when(k == 1, tab("S", "alone")).when(k == 2, tab("Q", "x")).when(k == 3, tab("L", "a", "?", "b", "+", "*")).otherwise(tab("W", "s", "x", "c", "0", "9", ">a"))
    rows = derive.load(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("ord"), F.explode(F.array(line, F.lit("# note"), F.lit("  "))).alias("line"))
    return gfa_text.parse(rows).rejects.groupBy("reason").agg(F.count("*").alias("n"))


@register(sql("SELECT name, CASE WHEN rc > 20 THEN 'TTTT' ELSE sequence END AS sequence FROM d_segments"))
def append_graphs(spark, d):
    """A graph appended to another: nodes merged, later values first."""
    s = derive.segments(spark, d)
    old = s.filter("cast(element_at(tags, 'RC').value as int) <= 25")
    new = s.filter("cast(element_at(tags, 'RC').value as int) > 20").withColumn("sequence", F.lit("TTTT"))
    return gr.append(gr.Graph.of(spark, segments=old), gr.Graph.of(spark, segments=new)).segments.select("name", "sequence")


@register(sql("SELECT path_name, CASE WHEN n > 4 THEN 1 ELSE n END AS n FROM d_paths"))
def overwrite_paths(spark, d):
    """Paths added once more overwrite those of their name."""
    g = derive.graph(spark, d)
    short = g.paths.filter("size(steps) > 4").withColumn("steps", F.slice("steps", 1, 1))
    return el.add(g, "path", short).paths.select("path_name", F.size("steps").cast("bigint").alias("n"))


@register(sql("SELECT eid FROM d_links WHERE (least(from_node,to_node), greatest(from_node,to_node)) NOT IN (SELECT (least(from_node,to_node), greatest(from_node,to_node)) FROM d_links WHERE alignment='*')"))
def remove_edges_by_pair(spark, d):
    """Without the links of every node pair that has one of unknown alignment."""
    links = derive.links(spark, d)
    return el.remove_pairs(links, links.filter("alignment = '*'").select(F.col("to_node").alias("u"), F.col("from_node").alias("v"))).select("eid")


@register(sql("SELECT eid FROM d_links WHERE alignment<>'*'"))
def remove_edges_by_id(spark, d):
    g = derive.graph(spark, d)
    return gr.remove_links(g, g.links.filter("alignment = '*'").select(F.col("eid").alias("id"))).links.select("eid")


@register(sql("SELECT path_name AS id FROM d_paths WHERE n <= 3 UNION ALL SELECT sample_id||'_'||hapindex||'_'||seq_id||'_'||seq_start||'_'||seq_end FROM d_walks WHERE n > 1"))
def remove_paths_walks(spark, d):
    g = derive.graph(spark, d)
    g = el.remove(g, "path", g.paths.filter("size(steps) > 3").select(F.col("path_name").alias("id")))
    g = el.remove(g, "walk", g.walks.filter("size(steps) = 1").select(F.col("walk_key").alias("id")))
    return g.paths.select(F.col("path_name").alias("id")).union(g.walks.select("walk_key"))


@register(sql("SELECT id, kind FROM (SELECT 'p'||p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'node' WHEN p_partkey % 4 = 1 THEN 'subgraph' WHEN p_partkey % 4 = 2 THEN 'path' ELSE 'edge' END AS kind FROM part)"))
def get_by_id_collisions(spark, d):
    """Every id is a node's, a stored subgraph's, a path's and an edge's, as far as its number lets it."""
    s = derive.segments(spark, d)
    k = F.col("ord") % 4
    none = F.lit(None)
    paths = s.filter(k <= 2).select("ord", F.col("name").alias("path_name"), F.array().cast(gr.STEPS).alias("steps"), F.array().cast("array<string>").alias("overlaps"), none.cast(gr.TAGS).alias("tags"))
    groups = s.filter(k <= 1).select("ord", F.col("name").alias("sub_id"), F.array().cast("array<struct<id:string,orn:string>>").alias("elements"), none.cast(gr.TAGS).alias("tags"))
    links = s.select("ord", F.col("name").alias("eid"), F.lit("L").alias("kind"), F.col("name").alias("from_node"), F.lit("+").alias("from_orn"), F.col("name").alias("to_node"), F.lit("+").alias("to_orn"), F.lit("*").alias("alignment"), none.cast("bigint").alias("pos"), none.cast("bigint").alias("distance"), none.cast("string").alias("variance"), none.cast(gr.TAGS).alias("tags"))
    g = gr.Graph.of(spark, segments=s.filter(k == 0), links=links, paths=paths, subgraphs=groups)
    return gr.get_by_id(g, s.select(F.col("name").alias("id")))


@register(sql("SELECT name AS id FROM d_segments WHERE rc % 2 = 0 UNION ALL SELECT path_name FROM d_paths WHERE n = 7"))
def membership(spark, d):
    g = derive.graph(spark, d)
    some = g.segments.filter("cast(element_at(tags, 'RC').value as int) % 2 = 0").select(F.col("name").alias("id"))
    ids = some.union(g.paths.filter("size(steps) = 7").select("path_name")).union(g.segments.select(F.concat(F.lit("no "), "name")))
    return el.contains(g, ids)


@register(sql("SELECT name AS id, 'name, sequence or length' AS reason FROM d_segments WHERE rc = 1 UNION ALL SELECT eid, 'ends or orientations' FROM d_links WHERE alignment='*' UNION ALL SELECT path_name, 'steps or overlaps' FROM d_paths WHERE n > 6"))
def invalid_rows(spark, d):
    """Rows that break a constraint, in a graph where some were made to."""
    g = derive.graph(spark, d)
    s = g.segments.withColumn("sequence", F.when(F.element_at("tags", "RC")["value"] == "1", "AC GT").otherwise(F.col("sequence")))
    e = g.links.withColumn("to_orn", F.when(F.col("alignment") == "*", "?").otherwise(F.col("to_orn")))
    p = g.paths.withColumn("overlaps", F.when(F.size("steps") > 6, F.array(F.lit("1M"))).otherwise(F.col("overlaps")))
    return gr.invalid(gr.replace(g, segments=s, links=e, paths=p)).select("id", "reason")


@register(sql("SELECT 'node' AS kind, name AS id FROM d_segments WHERE ord <= 20 UNION ALL SELECT 'edge', eid FROM d_links WHERE CAST(substr(from_node,2) AS INT) <= 20 AND CAST(substr(to_node,2) AS INT) <= 20"))
def stored_subgraph(spark, d):
    """A subgraph that names its nodes, as a graph."""
    g = derive.graph(spark, d)
    some = g.segments.filter("ord <= 20").agg(F.collect_list(F.struct(F.col("name").alias("id"), F.lit(None).cast("string").alias("orn"))).alias("elements"))
    sub = some.select(F.lit(0).cast("bigint").alias("ord"), F.lit("first").alias("sub_id"), "elements", F.lit(None).cast(gr.TAGS).alias("tags"))
    found = gr.stored_subgraph(gr.replace(g, subgraphs=sub), "first")
    return found.segments.select(F.lit("node").alias("kind"), F.col("name").alias("id")).union(found.links.select(F.lit("edge"), "eid"))


@register("SELECT true AS same, false AS other, true AS renamed")
def graph_comparison(spark, d):
    """Equality, and equality but for names, of the chains of some orders and changed copies of them."""
    g = derive.chain_graph(spark, d)
    few = F.col("ord") < 200 * 1000
    g = gr.replace(g, segments=cut(g.segments.filter(few), "segments"), links=cut(g.links.filter(few), "links"))
    name = lambda c: F.concat(F.lit("x"), F.md5(F.col(c).cast("binary")))
    copy = gr.replace(g, segments=g.segments.withColumn("name", name("name")), links=g.links.withColumn("from_node", name("from_node")).withColumn("to_node", name("to_node")))
    first = g.links.agg(F.min("eid")).first()[0]
    turned = F.when(F.col("eid") == first, F.lit("-")).otherwise(F.col("to_orn"))
    other = gr.replace(g, links=g.links.withColumn("to_orn", turned))
    row = (gr.equal(g, g), gr.equal(g, other), al.isomorphic(g, copy))
    return spark.createDataFrame([row], "same boolean, other boolean, renamed boolean")


@register(sql("""SELECT a.name, CASE WHEN b.name IS NULL THEN a.sequence ELSE a.sequence||substr(b.sequence, a.k+1) END AS sequence, CASE WHEN b.name IS NOT NULL THEN a.name||'+,'||b.name||'+' END AS fu
 FROM c_segments a LEFT JOIN c_segments b ON b.l_orderkey=a.l_orderkey AND b.rn=a.rn+1 AND b.l_linestatus=a.l_linestatus AND a.rn % 2 = 1
 WHERE a.rn % 2 = 1 OR NOT EXISTS (SELECT 1 FROM c_segments z WHERE z.l_orderkey=a.l_orderkey AND z.rn=a.rn-1 AND z.l_linestatus=a.l_linestatus)"""))
def compaction_by_edges(spark, d):
    """Only the links behind every other segment are merged."""
    g = derive.chain_graph(spark, d)
    segments, _ = al.compact_by_edges(g, g.links.filter("ord % 1000 % 2 = 1"))
    return segments.select("name", "sequence", "fu")


@register(sql("SELECT l.name AS from_node, r.name AS to_node, 'e'||l.ord AS eid FROM c_chains l JOIN longest USING (l_orderkey, l_linestatus, isl) JOIN c_segments r ON r.l_orderkey=l.l_orderkey AND r.rn=l.rn+1 AND r.l_linestatus=l.l_linestatus", "longest AS (SELECT l_orderkey, l_linestatus, isl FROM c_chains GROUP BY ALL ORDER BY count(*) DESC, min(ord) LIMIT 1)"))
def simple_path_edges(spark, d):
    """The links of the path along the longest chain, the first of these."""
    g = derive.chain_graph(spark, d)
    chain = al.components(g).join(g.segments.select(F.col("name").alias("node"), "ord"), "node").groupBy("component")
    most = chain.agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.min_by("node", "ord").alias("first"), F.max_by("node", "ord").alias("last")).orderBy(F.desc("n"), "ord").first()
    found = al.simple_paths(g.links, most["first"], most["last"], most["n"], edges=True)
    return found.select(F.explode("links").alias("l")).select("l.*")


@register(f"""WITH {STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY compression_option ORDER BY ratio_median DESC, compression_value) AS a, row_number() OVER (PARTITION BY compression_option ORDER BY decode_ms, compression_value) AS b FROM rk)
 SELECT 'best-ratio' AS mode, compression_option, compression_value, CAST(a AS INT) AS rank FROM r WHERE a<=4 UNION ALL SELECT 'best-speed', compression_option, compression_value, CAST(b AS INT) FROM r WHERE b<=4""")
def rank_modes(spark, d):
    ranked = an.ranking(derive.codec_stats(spark, d))
    each = [an.top(ranked, m, 4).select(F.lit(m).alias("mode"), "compression_option", "compression_value", "rank") for m in ("best-ratio", "best-speed")]
    return each[0].union(each[1])


@register(f"WITH {STATS} SELECT compression_option, compression_value, round(ratio_mean,5) AS ratio_mean, round(encode_ms,5) AS encode_ms, datasets FROM rk")
def ranking_from_csv(spark, d):
    """Measurements written as CSV by two runs, scanned and ranked."""
    rows = derive.codec_stats(spark, d)
    paths = []
    for k in (0, 1):
        paths.append(_folder(spark, "csv"))
        rows.filter(F.pmod(F.xxhash64("compression_value"), F.lit(2)) == k).write.csv(paths[-1], header=True)
    ranked = an.ranking(rp.read_stats(spark, *paths))
    return ranked.select("compression_option", "compression_value", F.round("ratio_mean", 5).alias("ratio_mean"), F.round("encode_ms", 5).alias("encode_ms"), "datasets")


@register(f"WITH {STATS} SELECT ds AS original_gfa, CASE WHEN ds='N' THEN '' ELSE ds||' size' END AS size, 'run' AS tool, count(*) AS n FROM st GROUP BY ds")
def stats_with_characteristics(spark, d):
    """Measurements with a constant column and the characteristics of their data set, where it has some."""
    chars = spark.createDataFrame([("A", "A size"), ("R", "R size")], "file string, size string")
    rows = rp.with_characteristics(rp.annotate(derive.codec_stats(spark, d), tool="run"), chars)
    return rows.groupBy("original_gfa", "size", "tool").agg(F.count("*").alias("n"))


@register(sql("""SELECT 'node '||name||' length='||CASE WHEN sequence='*' THEN '*' ELSE CAST(length(sequence) AS VARCHAR) END||' sequence='||sequence||' RC:i:'||rc AS text FROM d_segments
 UNION ALL SELECT 'edge '||eid||' '||from_node||from_orn||' -> '||to_node||to_orn||' alignment='||alignment FROM d_links
 UNION ALL SELECT 'path '||path_name||' '||steps FROM d_paths"""))
def pretty_listing(spark, d):
    return rp.listing(derive.graph(spark, d)).filter("section < 4").select("text")


def _names(table: dict) -> str:
    return "[" + ",".join(f"'{n}'" for n in table) + "]"


@register(f"SELECT codec, count(DISTINCT l_orderkey) AS lists, true AS same FROM lineitem, (SELECT unnest({_names(codecs.INTEGER_CODES)}) AS codec) GROUP BY codec")
def integer_codecs_round_trip(spark, d):
    """Every integer codec over the parts of each order, as bytes and back; parts that a codec cannot hold, in digits."""
    lists = derive.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("v"))
    rows = lists.select(codecs.round_trips(F.col("v"), *codecs.INTEGER_CODES, digits=True).alias("t"))
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("codec"), F.col("t")[k]["same"].alias("same")) for k in codecs.INTEGER_CODES])).alias("x")).select("x.*")
    return each.groupBy("codec").agg(F.count("*").alias("lists"), F.bool_and("same").alias("same"))


@register(f"SELECT codec, count(DISTINCT c_nationkey) AS lists, true AS same FROM customer, (SELECT unnest({_names(codecs.STRING_CODES)}) AS codec) GROUP BY codec")
def string_codecs_round_trip(spark, d):
    """Every string codec over the names and segments of each nation's customers, as bytes and back."""
    lists = derive.load(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "c_name", "c_mktsegment"))).alias("v"))
    lists = cut(lists, "lists")
    out = None
    for name in codecs.STRING_CODES:
        back = codecs.decoded_strings(codecs.encoded_strings(F.col("v"), "varint-" + name), F.size("v"), "varint-" + name)
        part = lists.select(F.lit(name).alias("codec"), (back == F.col("v")).alias("same"))
        out = part if out is None else out.union(part)
    return out.groupBy("codec").agg(F.count("*").alias("lists"), F.bool_and("same").alias("same"))


LIST_CODECS = dict.fromkeys(["superstring_none", "superstring_huffman", "superstring_two_bit_dna", "superstring_ppm", "model"])


@register(f"SELECT codec, count(DISTINCT c_nationkey) AS lists, count(*) AS strings, true AS same FROM customer, (SELECT unnest({_names(LIST_CODECS)}) AS codec) GROUP BY codec")
def list_codecs_round_trip(spark, d):
    """Superstring codecs and the order-k model over the segments and numbers of each nation's customers."""
    lists = derive.load(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.concat("c_mktsegment", F.col("c_custkey").cast("string")))).alias("v"))
    lists = cut(lists, "lists")
    out = None
    for name in LIST_CODECS:
        back = lists_of.decoded_list(lists_of.encoded_list(F.col("v"), name), F.size("v"), name)
        part = lists.select(F.lit(name).alias("codec"), F.size("v").alias("n"), (back == F.col("v")).alias("same"))
        out = part if out is None else out.union(part)
    return out.groupBy("codec").agg(F.count("*").alias("lists"), F.sum("n").alias("strings"), F.bool_and("same").alias("same"))


@register(sql("SELECT from_node, count(*) AS cigars, true AS same FROM d_links GROUP BY from_node"))
def cigar_lists_round_trip(spark, d):
    """The alignments of each segment's links as one CIGAR list, as bytes and back."""
    lists = derive.links(spark, d).groupBy("from_node").agg(F.sort_array(F.collect_list("alignment")).alias("v"))
    back = lists_of.decoded_list(lists_of.encoded_list(F.col("v"), "cigar"), F.size("v"), "cigar")
    return lists.select("from_node", F.size("v").cast("bigint").alias("cigars"), (back == F.col("v")).alias("same"))


@register(sql("SELECT eid, CAST(n AS VARCHAR)||'M'||n||'I1D2N3S4H5P6=7X' AS cigar, 9 AS ops, CAST(2*n+28 AS BIGINT) AS total, '012345678' AS codes FROM (SELECT eid, length(from_node) AS n FROM d_links)"))
def cigar_letters(spark, d):
    """CIGARs of all operations, parsed; a letter's code is its place."""
    n = F.length("from_node").cast("string")
    cigar = F.concat(n, F.lit("M"), n, F.lit("I1D2N3S4H5P6=7X"))
    rows = derive.links(spark, d).select("eid", cigar.alias("cigar")).withColumn("p", sq.cigar_parse(F.col("cigar")))
    code = F.when(F.col("p").isNotNull(), F.array_join(F.transform("p", lambda x: F.when(x["op"] == "X", "8").when(x["op"] == "=", "7").otherwise(x["code"].cast("string"))), ""))
    return rows.select("eid", "cigar", F.size("p").alias("ops"), F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("total"), code.alias("codes"))


@register(sql("SELECT path_name, n, steps AS signed, replace(replace(steps,'-',''),'+','') AS names FROM d_paths"))
def walk_forms(spark, d):
    """Both written forms of the steps parse alike."""
    p = derive.paths(spark, d)
    arrow = F.array_join(F.transform("steps", lambda s: F.concat(F.when(s["orn"] == "-", "<").otherwise(">"), s["seg"])), "")
    signed = F.array_join(F.transform("steps", lambda s: F.concat(s["seg"], s["orn"])), "")
    rows = p.select("path_name", sq.steps_of(arrow).alias("a"), sq.steps_of(signed).alias("b")).filter("a = b")
    return rows.select("path_name", F.size("a").cast("bigint").alias("n"), sq.steps_text(F.col("a")).alias("signed"), F.array_join(F.transform("b", lambda s: s["seg"]), ",").alias("names"))


@register("""SELECT c_custkey, regexp_full_match(c_mktsegment, '[ACGTNacgtn]*') AS dna, c_nationkey*256+5 AS packed, c_nationkey AS high, 5 AS low, c_name||'#1#'||c_mktsegment||':0-9' AS pansn, c_nationkey+9 AS walk, c_name||'|+' AS oriented,
 translate(reverse(c_mktsegment), 'AaCcGgTt', 'TtGgCcAa') AS rc, true AS i_ok, false AS bad_i, true AS f_ok, c_acctbal AS real, false AS a_ok FROM customer""")
def scalar_functions(spark, d):
    c = derive.load(spark, d, "customer")
    packed = sq.pack_code(F.col("c_nationkey"), F.lit(5))
    parts = sq.unpack_code(packed)
    real = sq.tag_value(F.lit("f"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    simple = F.translate(sq.reverse_complement_as_is(F.translate("c_mktsegment", "BbDdHhKkMmNnRrSsUuVvWwYy", "012345678!@#$%^&()-_[]{}")), "012345678!@#$%^&()-_[]{}", "BbDdHhKkMmNnRrSsUuVvWwYy")
    return c.select("c_custkey", sq.is_dna(F.col("c_mktsegment")).alias("dna"), packed.cast("int").alias("packed"), F.get(parts, 0).cast("int").alias("high"), F.get(parts, 1).cast("int").alias("low"), sq.pansn(F.col("c_name"), F.lit(1), F.col("c_mktsegment"), F.lit(0), F.lit(9)).alias("pansn"), sq.walk_length(F.lit(-9), F.col("c_nationkey")).alias("walk"), sq.oriented_name(F.col("c_name"), F.lit("+")).alias("oriented"), simple.alias("rc"), sq.tag_valid(F.lit("i"), F.col("c_custkey").cast("string")).alias("i_ok"), sq.tag_valid(F.lit("i"), F.col("c_name")).alias("bad_i"), real["valid"].alias("f_ok"), real["real"].alias("real"), sq.tag_valid(F.lit("A"), F.col("c_name")).alias("a_ok"))


@register(sql("SELECT 'segments' AS section_type, unnest(['names','sequences']) AS field, CAST(ceil(count(*)/65535.0) AS BIGINT) AS blocks, true AS correct FROM d_segments"))
def block_validation(spark, d):
    """Each block's fields decoded and held against the heads: those of the segments are
    listed, as correct if nothing in the file is wrong."""
    report = block_file.validate(spark, _block_file(spark, d))
    wrong = report.filter("not correct").count()
    kind = F.when(F.col("section_id") == block_file.SEGMENTS, "segments")
    rows = report.select(kind.alias("section_type"), F.col("section_field").alias("field"), (F.col("correct") & F.lit(wrong == 0)).alias("correct")).filter("section_type is not null")
    return rows.groupBy("section_type", "field").agg(F.count("*").alias("blocks"), F.bool_and("correct").alias("correct"))
