"""Parsing and formatting steps of the readers and writers, on rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.catalog.base import SEQS, query, sequences, table, with_ctes
from exonloom.operators import annotation as an
from exonloom.operators import matching as ma
from exonloom.operators import motifs as mo
from exonloom.sources import annotation as ga
from exonloom.sources import intervals as gi
from exonloom.sources import motifs as gm
from exonloom.sources import sinks
from exonloom.sources import tables as gt
from exonloom.sources import variants as gv

_text = lambda c: F.col(c).cast("string")


@query(
    "gtf_attributes",
    """select p_partkey, 'G' || p_partkey as gene_id, string_split(p_name, ' ')[1] as gene_name,
              'tag_' || p_size || ';' || lower(p_type) as tag, case when p_size % 2 = 0 then p_brand end as transcript_id from part""",
)
def gtf_attributes(spark, folder):
    quoted = lambda key, value: F.concat(F.lit(f'{key} "'), value, F.lit('"'))
    attribute = F.concat(
        F.concat_ws(
            "; ",
            quoted("gene_id", F.concat(F.lit("G"), _text("p_partkey"))), quoted("gene_name", F.col("p_name")),
            quoted("tag", F.concat(F.lit("tag_"), _text("p_size"))), quoted("tag", F.lower("p_type")),
            F.when(F.col("p_size") % 2 == 0, quoted("transcript_id", F.col("p_brand"))),
        ),
        F.lit(";"),
    )
    df = table(spark, folder, "part").select("p_partkey", attribute.alias("attribute"))
    return ga.expand_attributes(df, keys=["gene_id", "gene_name", "tag", "transcript_id"])


@query(
    "interval_strings",
    """select 'chr' || (o_custkey % 22) as chrom, o_orderkey * 10 - 1 as "start", o_orderkey * 10 + o_custkey as "end",
              'chr' || (o_custkey % 22) || ':' || o_orderkey * 10 || '-' || (o_orderkey * 10 + o_custkey) as name,
              case when o_orderkey % 2 = 0 then '+' else '-' end as strand from orders""",
)
def interval_strings(spark, folder):
    coords = F.concat(
        F.lit("chr"), (F.col("o_custkey") % 22).cast("string"), F.lit(":"), (F.col("o_orderkey") * 10).cast("string"),
        F.lit("-"), (F.col("o_orderkey") * 10 + F.col("o_custkey")).cast("string"),
    )
    df = table(spark, folder, "orders").select(
        coords.alias("target_coordinates"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("Strand")
    )
    return gi.intervals_from_strings(df, "target_coordinates", zero_based=False)


@query(
    "header_intervals",
    """select event_id, case when event_id % 3 > 0 then 'c' || user_id end as chrom, case when event_id % 3 > 0 then event_id end as "start",
              case when event_id % 3 > 0 then event_id + 50 end as "end", case when event_id % 3 > 0 then '-' end as strand from events""",
)
def header_intervals(spark, folder):
    header = F.when(
        F.col("event_id") % 3 > 0,
        F.concat(F.lit("c"), _text("user_id"), F.lit(":"), _text("event_id"), F.lit("-"), (F.col("event_id") + 50).cast("string"), F.lit("(-)_tx")),
    ).otherwise(F.concat(F.lit("plain"), _text("event_id")))
    df = table(spark, folder, "events").select("event_id", header.alias("seq_id"))
    return gi.header_intervals(df).drop("seq_id")


@query(
    "site_index_columns",
    """select o_orderkey, case when o_orderkey % 3 > 0 then o_custkey end as start_exon_upstream, case when o_orderkey % 3 > 0 then o_custkey + 9 end as end_exon_upstream,
              o_custkey + 20 as start_exon_cassette, o_custkey + 30 as end_exon_cassette, null::bigint as start_exon_downstream, null::bigint as end_exon_downstream from orders""",
)
def site_index_columns(spark, folder):
    n = lambda d: (F.col("o_custkey") + d).cast("string")
    outer = lambda v: F.when(F.col("o_orderkey") % 3 > 0, v).otherwise("<NA>")
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.concat_ws(";", outer(n(0)), n(20), F.lit("<NA>")).alias("acceptor_idx"),
        F.concat_ws(";", outer(n(9)), n(30), F.lit("<NA>")).alias("donor_idx"),
    )
    return gt.site_columns(df)


# orders as variants: a deletion, an insertion or a substitution by order status
_VCF_SQL = """
v as (select case when o_custkey % 24 = 22 then 'X' when o_custkey % 24 = 23 then 'MT' else cast(o_custkey % 24 + 1 as varchar) end as chrom, o_orderkey + 1 as pos, 'rs' || o_orderkey as id,
        case o_orderstatus when 'F' then 'ACGT' else 'A' end as ref, case o_orderstatus when 'O' then 'AGG' else 'G' end as alt, o_custkey, o_orderkey from orders)
"""


def _vcf(spark, folder):
    n = F.col("o_custkey") % 24
    info = F.concat(
        F.lit("DP=3;CSQ=G|"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("-1"), F.lit("|g"), _text("o_custkey"),
        F.lit("|sym|t"), _text("o_orderkey"), F.lit("|h|2/5||SNV,G|1|other|x|y|z|||"),
    )
    return table(spark, folder, "orders").select(
        F.when(n == 22, "X").when(n == 23, "MT").otherwise((n + 1).cast("string")).alias("chrom"),
        (F.col("o_orderkey") + 1).alias("pos"), F.concat(F.lit("rs"), _text("o_orderkey")).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "ACGT").otherwise("A").alias("ref"),
        F.when(F.col("o_orderstatus") == "O", "AGG").otherwise("G").alias("alt"),
        F.lit("50").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"), F.lit("").alias("rest"),
    )


_FIELDS = ["Allele", "STRAND", "Gene", "SYMBOL", "Feature", "HGVSc", "EXON", "INTRON", "VARIANT_CLASS"]


@query(
    "variant_intervals",
    "with " + _VCF_SQL + """select chrom, pos - 1 as "start", pos + case when length(ref) > length(alt) then length(ref) else length(alt) end - 1 as "end",
        pos, id, ref, alt, case when o_orderkey % 2 = 0 then '+' else '-' end as strand, 't' || o_orderkey as transcript_id, 'g' || o_custkey as gene_id from v""",
)
def variant_intervals(spark, folder):
    return gv.variant_intervals(_vcf(spark, folder), _FIELDS).select(
        "chrom", "start", "end", "pos", "id", "ref", "alt", "strand", "transcript_id", "gene_id"
    )


@query(
    "variant_chromosome_names",
    "with " + _VCF_SQL + "select id, 'chr' || case when chrom = 'MT' then 'M' else chrom end as chrom from v",
)
def variant_chromosome_names(spark, folder):
    return gv.fix_chromosome_names(_vcf(spark, folder)).select("id", "chrom")


@query(
    "variant_genes",
    "select 'g' || c_custkey as gene_id, 'chr' || (c_nationkey % 22 + 1) as chrom from customer where c_custkey in (select o_custkey from orders)",
)
def variant_genes(spark, folder):
    genes = table(spark, folder, "customer").select(
        F.concat(F.lit("g"), _text("c_custkey")).alias("gene_id"), (F.col("c_nationkey") % 22 + 1).cast("string").alias("chrom")
    )
    return gv.gene_intervals(gv.variant_intervals(_vcf(spark, folder), _FIELDS), genes)


@query(
    "variants_annotated",
    "with " + _VCF_SQL + """select id, case when o_orderkey % 5 = 0 then 'SCORE=' || o_custkey else 'SCORE=.' end as added from v""",
)
def variants_annotated(spark, folder):
    vcf = _vcf(spark, folder)
    values = vcf.filter("pos % 5 = 1").select(
        "chrom", "pos", "ref", "alt", F.regexp_extract("info", r"\|g(\d+)\|", 1).alias("score")
    )
    out = gv.annotate_variants(vcf, values, "score", "SCORE")
    return out.select("id", F.regexp_extract("info", r"(SCORE=[^;]*)$", 1).alias("added"))


@query(
    "bed_rows",
    """select 'chr' || l_suppkey as chrom, l_orderkey as "start", l_orderkey + 10 as "end", '.' as name, '.' as score, l_linestatus as strand from lineitem""",
)
def bed_rows(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.concat(F.lit("chr"), _text("l_suppkey")).alias("chrom"), (F.col("l_orderkey") + 1).alias("start"),
        (F.col("l_orderkey") + 10).alias("end"), F.col("l_linestatus").alias("strand"),
    )
    return sinks.bed_frame(df, one_based=True)


@query(
    "position_tracks",
    """select 'v' || vec_id as chrom, case when vec_id % 2 = 0 then 1000 + i else 1063 - i end as "start",
              case when vec_id % 2 = 0 then 1001 + i else 1064 - i end as "end", floor(embedding[i + 1]::double * 1000) as score
       from embeddings, unnest(range(64)) t(i)""",
)
def position_tracks(spark, folder):
    scores = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double"))
    df = table(spark, folder, "embeddings").select(
        F.concat(F.lit("v"), _text("vec_id")).alias("chrom"), F.lit(1000).cast("bigint").alias("start"), F.lit(1064).cast("bigint").alias("end"),
        F.when(F.col("vec_id") % 2 == 0, "+").otherwise("-").alias("strand"), scores.alias("scores"),
    )
    return sinks.position_track(df, "scores")


@query(
    "fasta_rows",
    "select '>doc' || doc_id || chr(10) || text as value from documents where text is not null",
)
def fasta_rows(spark, folder):
    df = table(spark, folder, "documents").select(
        F.concat(F.lit("doc"), _text("doc_id")).alias("seq_id"), F.col("text").alias("seq")
    )
    return sinks.fasta_lines(df)


@query(
    "scored_cells_to_kmers",
    """select distinct p_brand as rbp_name, upper(substr(w, 1, 3)) as motif from (select p_brand, unnest(string_split(p_name, ' ')) as w from part)""",
)
def scored_cells_to_kmers(spark, folder):
    cells = F.array_join(
        F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(3))), F.lit("_1_0.5"))), ";"
    )
    df = table(spark, folder, "part").select("p_brand", cells.alias("cells"))
    return gm.kmers_from_scored_cells(df, "p_brand", "cells")


@query(
    "matrix_ids",
    "select distinct p_brand as rbp_name, 'M' || p_size as motif_id from part where p_type = 'PROMO' and p_size % 7 <> 0",
)
def matrix_ids(spark, folder):
    df = table(spark, folder, "part").select(
        "p_type", "p_brand", F.when(F.col("p_size") % 7 == 0, ".").otherwise(F.concat(F.lit("M"), _text("p_size"))).alias("matrix")
    )
    return gm.motif_ids_from_table(df, "p_type", "p_brand", "matrix", "PROMO")


# a nation is a matrix of six positions; two bases pass the threshold where the key allows
def _matrices(spark, folder):
    s = table(spark, folder, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    k = (F.col("n_nationkey") + F.col("pos")) % 4
    other = (k + 1 + F.col("n_nationkey") % 2) % 4
    two = (F.col("n_nationkey") + F.col("pos")) % 3 == 0
    p = lambda i: F.when(k == i, F.when(two, 0.6).otherwise(0.91)).when((other == i) & two, 0.3).otherwise(F.when(two, 0.05).otherwise(0.03))
    return gm.pwm_rows(
        s.select(F.concat(F.lit("M"), _text("n_nationkey")).alias("motif_id"), F.concat(F.lit("R"), (F.col("n_nationkey") % 20).cast("string")).alias("rbp_name"),
                 "pos", F.array(*[p(i) for i in range(4)]).alias("v")),
        F.col("v"),
    )


_ALLOWED = "allowed as (select n_nationkey as k, i, unnest(case when (n_nationkey + i) % 3 = 0 then ['ACGT'[(n_nationkey + i) % 4 + 1], 'ACGT'[((n_nationkey + i) % 4 + 1 + n_nationkey % 2) % 4 + 1]] else ['ACGT'[(n_nationkey + i) % 4 + 1]] end) as b from nation, unnest(range(6)) t(i))"


@query(
    "unambiguous_kmers",
    "with " + _ALLOWED + """ select distinct 'R' || (a.k % 20) as rbp_name, a.b || b.b || c.b || d.b || e.b || f.b as motif from allowed a join allowed b on a.k = b.k and b.i = 1
       join allowed c on a.k = c.k and c.i = 2 join allowed d on a.k = d.k and d.i = 3 join allowed e on a.k = e.k and e.i = 4 join allowed f on a.k = f.k and f.i = 5 where a.i = 0""",
)
def unambiguous_kmers(spark, folder):
    return mo.unambiguous_kmers(_matrices(spark, folder))


# a matrix scores all words of its length; the share of words that score as much is the tail
@query(
    "matrix_scan",
    with_ctes(SEQS, """cells as (
         select n_nationkey as k, i, j, case when (n_nationkey + i) % 3 = 0 then case when j = own then 0.6 when j = other then 0.3 else 0.05 end
                                             else case when j = own then 0.91 else 0.03 end end as p
         from (select *, (own + 1 + n_nationkey % 2) % 4 as other from (select n_nationkey, i, j, (n_nationkey + i) % 4 as own
               from nation, unnest(range(6)) t(i), unnest(range(4)) u(j))))""",
        "weights as (select k, i, 'ACGT'[j + 1] as b, p, cast(round(log2((p + 1e-4) / (1 + 4e-4) / 0.25) * 100) as bigint) as w from cells)",
        "words as (select a.k, a.b || b.b || c.b || d.b || e.b || f.b as motif, a.w + b.w + c.w + d.w + e.w + f.w as score, least(a.p, b.p, c.p, d.p, e.p, f.p) as p from "
        + " join ".join(f"(select * from weights where i = {i}) {x}" + (f" on a.k = {x}.k" if i else "") for i, x in enumerate("abcdef")) + ")",
        "tails as (select *, count(*) over (partition by k order by score desc) / 4096.0 as tail from words)",
        "good as (select distinct 'R' || (k % 20) as rbp_name, motif from tails where tail <= 5e-4)",
        "allowed as (select distinct 'R' || (k % 20) as rbp_name, motif from words where p >= 0.15)",
        "places as (select seq_id, i, substr(seq, i + 1, 6) as motif from seqs, unnest(range(length(seq) - 5)) t(i))",
        body="""select seq_id, rbp_name, motif, i as "start", i + 6 as "end" from places join good using (motif) join allowed using (rbp_name, motif)"""),
)
def matrix_scan(spark, folder):
    matrices = _matrices(spark, folder)
    return mo.scan_matrices(sequences(spark, folder), matrices, 5e-4, allowed=mo.unambiguous_kmers(matrices))


@query(
    "run_statistics",
    """select 'n_events' as statistic, count(*) as value from orders union all select 'n_unique_events', count(distinct o_custkey) from orders
       union all select 'n_known', count(*) from orders where o_orderstatus <> 'P' union all select 'n_unique_known', count(distinct o_custkey) from orders where o_orderstatus <> 'P'
       union all select 'n_unknown', count(*) from orders where o_custkey not in (select o_custkey from orders where o_orderstatus <> 'P')
       union all select 'n_unique_unknown', count(distinct o_custkey) from orders where o_custkey not in (select o_custkey from orders where o_orderstatus <> 'P')
       union all select 'n_written', count(*) from orders where o_orderstatus = 'F' union all select 'n_first_or_last', count(*) from orders where o_orderstatus = 'O'
       union all select 'n_discarded', count(*) from orders where o_orderstatus = 'P'""",
)
def run_statistics(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("name"), "o_orderstatus")
    pick = lambda s: o.filter(F.col("o_orderstatus") == s)
    return sinks.run_statistics(o, o.filter("o_orderstatus <> 'P'"), pick("F"), pick("O"), pick("P"))


def _match_rows(spark, folder):
    """Parts as exons: six groups by type, large parts are responsive."""
    return table(spark, folder, "part").select(
        F.col("p_type").alias("rbp_name"), F.when(F.col("p_size") > 35, "KD").otherwise("CTRL").alias("exon_group"),
        F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("target"),
        F.col("p_retailprice").alias("a"), ((F.col("p_partkey") * 37) % 101).cast("double").alias("b"),
        (F.col("p_size") + 1).cast("double").alias("len"),
    )


def _greedy_sql(rows: str, features: list[str], distance: str, body: str) -> str:
    """One choice per step of a recursive query: the next chooser of each group takes its nearest free control."""
    gaps = distance.format(*[f"abs(c.{f} - k.{f})" for f in features])
    return f"""with recursive rows as ({rows}),
k as (select *, row_number() over (partition by grp order by ord) as n from rows where kd),
kinds as (select *, min(ord) over (partition by grp, {', '.join(features)}) as kind from rows where not kd),
c as (select grp, list({{'kind': kind, 'ord': ord, {', '.join(f"'{f}': {f}" for f in features)}}} order by ord) as controls from kinds group by grp),
taken(grp, n, free, kd_order, ctrl_order, distance) as (
  select grp, 0::bigint, controls, null::bigint, null::bigint, null::double from c
  union all
  select grp, n, list_filter(free, lambda x: x.ord <> best.ord), kd_order, best.ord, best.d from (
    select t.grp, k.n, t.free, k.ord as kd_order, list_min(list_transform(t.free, lambda c: {{'d': {gaps}, 'kind': c.kind, 'ord': c.ord}})) as best
    from taken t join k on k.grp = t.grp and k.n = t.n + 1) where best is not null),
pairs as (select grp as rbp_name, kd_order, ctrl_order, distance from taken where n > 0)
{body}"""


_MATCH_ROWS = """select p_type as grp, p_size > 35 as kd, p_partkey as ord, p_retailprice as a, ((p_partkey * 37) % 101)::double as b, (p_size + 1)::double as len from part"""


@query("greedy_match", _greedy_sql(_MATCH_ROWS, ["a", "b"], "sqrt(pow({0}, 2) + pow({1}, 2))", "select rbp_name, kd_order, ctrl_order, round(distance, 6) as distance from pairs"))
def greedy_match(spark, folder):
    pairs = ma.greedy_match(_match_rows(spark, folder), "rbp_name", "exon_group", "ord", "target", ["a", "b"])
    return pairs.withColumn("distance", F.round("distance", 6))


# many controls of equal features, and kinds at equal distances
_TIES = """select p_type as grp, p_size > 35 as kd, p_partkey as ord, (p_size % 5)::double as a, (p_partkey % 4)::double as b from part"""


@query("greedy_match_ties", _greedy_sql(_TIES, ["a", "b"], "({0} + {1})", "select rbp_name, kd_order, ctrl_order, distance from pairs"))
def greedy_match_ties(spark, folder):
    rows = _match_rows(spark, folder).withColumns({"a": (F.expr("cast(len as int)") - 1) % 5.0, "b": F.col("ord") % 4.0})
    return ma.greedy_match(rows, "rbp_name", "exon_group", "ord", "target", ["a", "b"], "cityblock")


_SCALED = f"""select grp, kd, ord, (a - avg(a) over w) / stddev_pop(a) over w as a, (b - avg(b) over w) / stddev_pop(b) over w as b,
    (log10(len) - avg(log10(len)) over w) / stddev_pop(log10(len)) over w as len from ({_MATCH_ROWS}) window w as (partition by grp)"""


@query(
    "greedy_match_scaled",
    _greedy_sql(_SCALED, ["a", "b", "len"], "({0} + {1} + {2}) / 3", """select rbp_name, kd_order, ctrl_order, round(distance, 6) as distance, round(x.a - y.a, 6) as scaled_a_diff,
        round(x.b - y.b, 6) as scaled_b_diff, round(x.len - y.len, 6) as scaled_len_diff from pairs join rows x on x.ord = kd_order join rows y on y.ord = ctrl_order"""),
)
def greedy_match_scaled(spark, folder):
    rows = ma.scale_features(_match_rows(spark, folder), "rbp_name", ["a", "b", "len"], ["len"])
    features = ["scaled_a", "scaled_b", "scaled_len"]
    pairs = ma.greedy_match(rows, "rbp_name", "exon_group", "ord", "target", features, "avg")
    out = ma.pair_differences(pairs, rows, "ord", features, ["rbp_name"])
    return out.withColumns({c: F.round(c, 6) for c in ("distance", *[f"{f}_diff" for f in features])})


@query(
    "scaled_features",
    """select p_partkey as ord, round((p_retailprice - m) / s, 6) as scaled_a, round((log10(p_size + 1) - ml) / sl, 6) as scaled_len from part join (
         select p_type, avg(p_retailprice) as m, stddev_pop(p_retailprice) as s, avg(log10(p_size + 1)) as ml, stddev_pop(log10(p_size + 1)) as sl from part group by 1) using (p_type)""",
)
def scaled_features(spark, folder):
    rows = ma.scale_features(_match_rows(spark, folder), "rbp_name", ["a", "len"], ["len"])
    return rows.select("ord", F.round("scaled_a", 6).alias("scaled_a"), F.round("scaled_len", 6).alias("scaled_len"))
