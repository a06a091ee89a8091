"""Tables written by the writers into the shared checkpoint folder and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from exonloom.catalog.base import EXONS, HITS, MOTIFS, MOTIFS_CTE, ORACLES, SEQS, exons, hits, query, sequences, table, with_ctes
from exonloom.catalog.stats_queries import _rounded, _t_tails
from exonloom.operators import stats as st
from exonloom.plans.annotation_cache import drop_overlapping
from exonloom.session import ensure_checkpoint_dir
from exonloom.sources import annotation as ga
from exonloom.sources import framed
from exonloom.sources import intervals as gi
from exonloom.sources import motifs as gm
from exonloom.sources import sequences as gs
from exonloom.sources import sinks, splits
from exonloom.sources import tables as gt
from exonloom.sources import variants as gv
from exonloom.streaming import incremental

_text = lambda c: F.col(c).cast("string")


def _place(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}.{name}"


_EVENTS = """select 'u' || user_id as chrom, event_id * 10 as "start", event_id * 10 + cast(floor(value) as bigint) + 1 as "end", event_type as name from events"""


def _intervals(spark, folder):
    return table(spark, folder, "events").select(
        F.concat(F.lit("u"), _text("user_id")).alias("chrom"), (F.col("event_id") * 10).alias("start"),
        (F.col("event_id") * 10 + F.floor("value") + 1).alias("end"), F.col("event_type").alias("name"),
    )


@query("bed_round_trip", f"""select chrom, "start", "end", name, '.' as score, '.' as strand from ({_EVENTS})""")
def bed_round_trip(spark, folder):
    path = _place(spark, "bed")
    sinks.write_bed(_intervals(spark, folder), path)
    gi.bed_is_valid(spark, path, raise_error=True)
    return gi.read_bed(spark, path)


@query("bedgraph_round_trip", f"""select chrom, "start", "end", cast("end" - "start" as varchar) as name from ({_EVENTS})""")
def bedgraph_round_trip(spark, folder):
    path = _place(spark, "bedgraph")
    sinks.write_bedgraph(_intervals(spark, folder).withColumn("width", F.col("end") - F.col("start")), path, "width")
    return gi.read_bed(spark, path)


@query("ids_round_trip", "select 'c' || c_custkey as id from customer")
def ids_round_trip(spark, folder):
    path = _place(spark, "txt")
    sinks.write_ids(table(spark, folder, "customer").select(F.concat(F.lit("c"), _text("c_custkey")).alias("id")), path, "id")
    return ga.read_ids(spark, path)


# two files with different columns, joined by name
@query(
    "tsv_union",
    """select cast(p_partkey as varchar) as key, p_brand as brand, null::varchar as size from part
       union all select cast(p_partkey as varchar), p_brand, cast(p_size as varchar) from part""",
)
def tsv_union(spark, folder):
    part = table(spark, folder, "part").select(_text("p_partkey").alias("key"), F.col("p_brand").alias("brand"), _text("p_size").alias("size"))
    one, two = _place(spark, "tsv"), _place(spark, "tsv")
    sinks.write_tsv(part.drop("size"), one)
    sinks.write_tsv(part, two, gzip=False)
    return gt.read_tsv_union(spark, [one, two]).select("key", "brand", "size")


@query("fasta_round_trip", with_ctes(SEQS, body="select seq_id, seq from seqs where seq <> ''"))
def fasta_round_trip(spark, folder):
    path = _place(spark, "fasta")
    sinks.write_fasta(sequences(spark, folder).filter("seq <> ''"), path, files=3)
    return gs.read_fasta(spark, path)


@query("hits_round_trip", with_ctes(SEQS, MOTIFS_CTE, HITS, body='select seq_id, rbp_name, motif, "start", "end" from hits'))
def hits_round_trip(spark, folder):
    path = _place(spark, "tsv")
    sinks.write_tsv(hits(spark, folder), path)
    return gm.read_hits(spark, path)


@query(
    "vcf_round_trip",
    "select 'chr' || (o_custkey % 22 + 1) as chrom, o_orderkey as pos, 'id' || o_orderkey as id, 'A' as ref, 'T' as alt, '.' as qual, o_orderstatus as \"filter\", '.' as info, '' as rest from orders",
)
def vcf_round_trip(spark, folder):
    path = _place(spark, "vcf")
    gv.vcf_lines(_orders_as_variants(spark, folder)).write.text(path)
    return gv.read_vcf(spark, path)


def _orders_as_variants(spark, folder):
    return table(spark, folder, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")).alias("chrom"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("id"), _text("o_orderkey")).alias("id"),
        F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.lit(".").alias("qual"), F.col("o_orderstatus").alias("filter"), F.lit(".").alias("info"), F.lit("").alias("rest"),
    )


@query(
    "raw_predictions",
    "select 'v' || vec_id as seq_id, i::bigint as pos, embedding[i + 1]::double as acceptor, -(embedding[i + 1]::double) as donor from embeddings, unnest(range(len(embedding))) t(i)",
)
def raw_predictions(spark, folder):
    path = _place(spark, "parquet")
    long = table(spark, folder, "embeddings").select(F.concat(F.lit("v"), _text("vec_id")).alias("seq_id"), F.posexplode("embedding").alias("pos", "x"))
    long.select("seq_id", F.col("pos").cast("bigint").alias("pos"), F.col("x").cast("double").alias("acceptor"), (-F.col("x").cast("double")).alias("donor"), F.lit(1).alias("other")).write.parquet(path)
    return gt.read_raw_predictions(spark, path)


# sequences arrive as a stream of files; their hits and deletions are appended once
@query(
    "appended_metadata",
    with_ctes(SEQS, MOTIFS_CTE, HITS, body="""select seq_id || '_DEL_' || "start" || '_' || "end" as id, seq_id, rbp_name, "start", "end",
        substr(seq, "start" + 1, "end" - "start") as mutation, 'DEL' as type, "start" as motif_start, "end" as motif_end from hits join seqs using (seq_id)"""),
)
def appended_metadata(spark, folder):
    source, out, state = (_place(spark, n) for n in ("source", "out", "state"))
    sequences(spark, folder).write.parquet(source)
    owners = {}
    for rbp, words in MOTIFS.items():
        for m in words:
            owners.setdefault(m, []).append(rbp)
    for _ in range(2):  # the second run finds nothing new
        incremental.append_metadata(incremental.read_sequences(spark, source, 3), owners, out, state).awaitTermination()
    return spark.read.parquet(out)


# one exon per gene stands for a target; those of every third transcript are novel
@query(
    "overlapping_targets_dropped",
    with_ctes(EXONS, """t as (select chrom, "start", "end", case when num % 3 = 0 then transcript_id || '_x' else transcript_id end as transcript_id, num % 17 as rank_score
            from (select *, cast(substr(transcript_id, 2) as bigint) as num from exons))""",
        """lab as (select *, sum(head) over (partition by chrom order by "start", "end" desc, transcript_id rows unbounded preceding) as grp from (
            select *, case when "start" <= max("end") over (partition by chrom order by "start", "end" desc, transcript_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as head from t))""",
        body="""select chrom, "start", "end", transcript_id, rank_score from (select *, row_number() over (partition by chrom, grp
            order by case when contains(transcript_id, '_') then 1 else 0 end, -rank_score, "start", transcript_id) as rn from lab) where rn = 1"""),
)
def overlapping_targets_dropped(spark, folder):
    num = F.substr("transcript_id", F.lit(2)).cast("bigint")
    rows = exons(spark, folder).select(
        "chrom", "start", "end", F.when(num % 3 == 0, F.concat("transcript_id", F.lit("_x"))).otherwise(F.col("transcript_id")).alias("transcript_id"), (num % 17).alias("rank_score")
    )
    return drop_overlapping(rows)[0]


@query(
    "paired_t_holm",
    f"""with s as (select l_returnflag, l_linestatus, avg(l_tax - l_discount) as m, stddev_samp(l_tax - l_discount) as sd, count(l_tax - l_discount) as n from lineitem group by 1, 2),
        q as (select *, (n - 1)::double as v, m / (sd / sqrt(n)) as t from s where n > 1 and sd > 0),
        p as (select l_returnflag, l_linestatus, t, greatest({_t_tails('v', 't')}, 0) as p from q),
        h as (select *, (count(*) over () - row_number() over (order by p, l_returnflag, l_linestatus) + 1) * p as s, row_number() over (order by p, l_returnflag, l_linestatus) as rn from p)
        select l_returnflag, l_linestatus, round(t, 4) as t, round(p, 5) as p_value, round(least(1.0, max(s) over (order by rn rows unbounded preceding)), 5) as p_holm from h""",
)
def paired_t_holm(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_tax", "l_discount")
    tests = st.paired_t(df, ["l_returnflag", "l_linestatus"], "l_tax", "l_discount").select("l_returnflag", "l_linestatus", "t", "p_value")
    out = st.holm(tests, "p_value", tie=["l_returnflag", "l_linestatus"])
    return _rounded(_rounded(out, "t", digits=4), "p_value", "p_holm", digits=5)


@query(
    "fasta_ranges_round_trip",
    with_ctes(SEQS, body="""select seq_id as chrom, k // 4096 as chunk_no, md5(substr(seq, k + 1, 4096)) as bases_md5, length(seq) as chrom_len
                            from seqs, unnest(range(0, length(seq), 4096)) t(k)"""),
)
def fasta_ranges_round_trip(spark, folder):
    path = _place(spark, "fasta")
    sinks.write_fasta(sequences(spark, folder).filter("seq <> ''"), path, files=3)
    chunks = splits.read_genome_ranges(spark, path, 4096, 200_000)
    return chunks.select("chrom", "chunk_no", F.md5("bases").alias("bases_md5"), "chrom_len")


@query("vcf_blocks_round_trip", ORACLES["vcf_round_trip"] + " union all select '#', null, '1', null, null, null, null, null, null")
def vcf_blocks_round_trip(spark, folder):
    path = _place(spark, "vcf")
    framed.write_vcf(_orders_as_variants(spark, folder), path, ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    lines = splits.read_block_lines(spark, path, 100_000)
    records = gv.parse_vcf(lines)
    # every file begins with the header; one row stands for their equal number of both lines
    heads = lines.filter("value like '#%'").groupBy("value").count().agg(F.countDistinct("count").cast("string").alias("id")).withColumn("chrom", F.lit("#"))
    return records.unionByName(heads, allowMissingColumns=True)


@query(
    "bed_track_round_trip",
    f"""select 'track name="events"' as value union all select chrom || chr(9) || "start" || chr(9) || "end" || chr(9) || name || chr(9) || '.' || chr(9) || '.' from ({_EVENTS})""",
)
def bed_track_round_trip(spark, folder):
    path = _place(spark, "bed")
    framed.write_bed_track(_intervals(spark, folder), path, 'name="events"')
    lines = spark.read.text(path)
    heads = F.col("value").startswith("track")
    return lines.filter(heads).distinct().unionByName(lines.filter(~heads))
