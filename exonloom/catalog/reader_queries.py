"""The parse steps of the file readers and the last step of the writers, on lines made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.catalog.base import query, table
from exonloom.operators import learn, tabular
from exonloom.sources import annotation as ga
from exonloom.sources import motifs as gm
from exonloom.sources import sequences as gs
from exonloom.sources import sinks
from exonloom.sources import tables as gt
from exonloom.sources import variants as gv

_text = lambda c: F.col(c).cast("string")


@query(
    "gtf_lines",
    """select 'chr' || p_size as chrom, 'src' as source, 'exon' as feature, p_partkey - 1 as "start", p_partkey + p_size as "end",
              case when p_partkey % 3 = 0 then p_size / 2.0 end::double as score, case when p_partkey % 2 = 0 then '+' else '-' end as strand,
              null::varchar as frame, 'gene_id "G' || p_partkey || '"; name "' || p_name || '";' as attribute from part""",
)
def gtf_lines(spark, folder):
    part = table(spark, folder, "part")
    line = F.concat_ws(
        "\t", F.concat(F.lit("chr"), _text("p_size")), F.lit("src"), F.lit("exon"), _text("p_partkey"), (F.col("p_partkey") + F.col("p_size")).cast("string"),
        F.when(F.col("p_partkey") % 3 == 0, (F.col("p_size") / 2).cast("string")).otherwise("."), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-"),
        F.lit("."), F.concat(F.lit('gene_id "G'), _text("p_partkey"), F.lit('"; name "'), "p_name", F.lit('";')),
    )
    noise = F.array(F.concat(F.lit("#comment\t"), "p_name"), F.lit(""), line)
    return ga.parse_gtf(part.select(F.explode(noise).alias("value")))


@query(
    "vcf_lines",
    """select 'chr' || (o_custkey % 22 + 1) as chrom, o_orderkey as pos, 'rs' || o_orderkey as id, 'A' as ref, case when o_orderkey % 2 = 0 then 'T' else 'ACG' end as alt,
              '.' as qual, o_orderstatus as "filter", 'P=' || o_orderpriority as info, case when o_orderkey % 5 = 0 then 'GT' || chr(9) || '0/1' else '' end as rest from orders""",
)
def vcf_lines(spark, folder):
    o = table(spark, folder, "orders")
    fixed = F.concat_ws(
        "\t", F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")), _text("o_orderkey"), F.concat(F.lit("rs"), _text("o_orderkey")), F.lit("A"),
        F.when(F.col("o_orderkey") % 2 == 0, "T").otherwise("ACG"), F.lit("."), "o_orderstatus", F.concat(F.lit("P="), "o_orderpriority"),
    )
    line = F.when(F.col("o_orderkey") % 5 == 0, F.concat(fixed, F.lit("\tGT\t0/1"))).otherwise(fixed)
    return gv.parse_vcf(o.select(F.explode(F.array(F.lit("##fileformat"), line)).alias("value")))


@query(
    "fasta_records",
    "select 'doc' || doc_id as seq_id, replace(replace(text, chr(13), ''), chr(10), '') as seq from documents",
)
def fasta_records(spark, folder):
    d = table(spark, folder, "documents")
    end = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\n")
    head = F.concat(F.when(F.col("doc_id") % 7 == 0, ">").otherwise(""), F.lit("doc"), _text("doc_id"), F.lit(" c.76A>T "), "lang")
    return gs.parse_fasta(d.select(F.concat(head, end, F.coalesce("text", F.lit(""))).alias("value")))


# five files, the first of which ends at a MOUSE line in the middle
@query(
    "motif_list_lines",
    """select distinct 'R' || p_partkey as rbp_name, translate(upper(w), 'U', 'T') as motif from (select p_partkey, p_size, unnest(string_split(p_name || ' AUGUU', ' ')) as w from part)
       where length(w) >= 5 and not (p_size % 5 = 0 and p_partkey > (select max(p_partkey) from part) // 2)""",
)
def motif_list_lines(spark, folder):
    part = table(spark, folder, "part")
    half = part.agg(F.floor(F.max("p_partkey") / 2).alias("m")).first()["m"] or 0
    file = F.concat(F.lit("f"), (F.col("p_size") % 5).cast("string"))
    words = F.translate(F.upper(F.concat("p_name", F.lit(" AUGUU"))), " ", "|")
    lines = part.select(
        file.alias("file"), "p_partkey",
        F.posexplode(F.array(F.concat(F.lit(">R"), _text("p_partkey"), F.lit("|9|")), F.concat(F.lit("*"), words))).alias("i", "line"),
    ).select("file", (F.col("p_partkey") * 2 + F.col("i")).alias("no"), "line")
    stop = spark.createDataFrame([("f0", half * 2 + 1, "MOUSE below")], lines.schema)
    shifted = lines.withColumn("no", F.when(F.col("no") > half * 2 + 1, F.col("no") + 1).otherwise(F.col("no")))
    return gm.parse_motif_list(shifted.unionByName(stop.withColumn("no", F.lit(half * 2 + 2).cast("bigint"))), 5)


# five files; a part is a matrix of four rows, named by the first word of its name
@query(
    "meme_lines",
    """select 'M' || p_partkey as motif_id, string_split(p_name, ' ')[1] as rbp_name, pos::int as pos, 'ACGT'[j + 1] as base,
              case when j = (p_partkey + pos) % 4 then 0.7 else 0.1 end::double as p from part, unnest(range(4)) t(pos), unnest(range(4)) u(j)""",
)
def meme_lines(spark, folder):
    n = table(spark, folder, "part")
    row = lambda pos: F.concat_ws(" ", *[F.when((F.col("p_partkey") + pos) % 4 == j, "0.7").otherwise("0.1") for j in range(4)])
    block = F.array(
        F.concat(F.lit("MOTIF M"), _text("p_partkey"), F.lit(" "), "p_name"), F.lit(""), F.lit("letter-probability matrix: alength= 4"),
        *[F.concat(F.lit(" "), row(i)) for i in range(4)],
    )
    lines = n.select((F.col("p_size") % 5).cast("string").alias("file"), "p_partkey", F.posexplode(block).alias("i", "line"))
    return gm.parse_meme(lines.select("file", (F.col("p_partkey") * 10 + F.col("i")).alias("no"), "line"))


@query(
    "fimo_hits",
    """select distinct 's' || l_partkey as seq_id, l_shipdate_flag as rbp_name, motif, s as "start", s + 6 as "end" from (
         select l_partkey, l_returnflag as l_shipdate_flag, case when l_linestatus = 'O' then 'ACGTAC' else 'GGGTTT' end as motif, l_suppkey as s from lineitem)""",
)
def fimo_hits(spark, folder):
    line = table(spark, folder, "lineitem")
    raw = line.select(
        F.concat(F.lit("s"), _text("l_partkey")).alias("sequence_name"), F.col("l_returnflag").alias("motif_alt_id"),
        F.when(F.col("l_linestatus") == "O", "ACGTAC").otherwise("GGGTTT").alias("matched_sequence"),
        (F.col("l_suppkey") + 1).cast("string").alias("start"), (F.col("l_suppkey") + 6).cast("string").alias("stop"),
    )
    return gm.fimo_hits(raw)


@query(
    "site_index_matched",
    """select 'h' || o_orderkey || '_t' || (o_custkey % 3) as seq_id, o_custkey as start_exon_upstream, null::bigint as end_exon_upstream, 2 * o_custkey as start_exon_cassette,
              o_orderkey as end_exon_cassette, case when o_orderkey % 2 = 0 then 7 end::bigint as start_exon_downstream, 9::bigint as end_exon_downstream from orders""",
)
def site_index_matched(spark, folder):
    o = table(spark, folder, "orders")
    index = o.select(
        F.concat(F.lit("h"), _text("o_orderkey")).alias("header"), F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tx_id"),
        F.concat_ws(";", _text("o_custkey"), (F.col("o_custkey") * 2).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "7").otherwise("<NA>")).alias("acceptor_idx"),
        F.concat_ws(";", F.lit("<NA>"), _text("o_orderkey"), F.lit("9")).alias("donor_idx"),
    )
    names = F.concat_ws("_", "header", "tx_id")
    seqs = index.select(F.explode(F.array(names, F.concat(names, F.lit("_REF_seq")))).alias("seq_id"))
    return gt.match_site_index(seqs, gt.site_columns(index))


@query(
    "tsv_columns",
    "select vec_id, label, array_to_string(list_transform(embedding, lambda x: case when x < 0 then '<NA>' else cast(cast(floor(x::double * 1000) as bigint) as varchar) end), ';') as scores from embeddings",
)
def tsv_columns(spark, folder):
    e = table(spark, folder, "embeddings")
    scores = F.transform("embedding", lambda x: F.when(x >= 0, F.floor(x.cast("double") * 1000)))
    return sinks.flat_columns(e.select("vec_id", "label", scores.alias("scores")))


@query("external_targets", "select 'c' || c_custkey as seq_id, case when c_mktsegment = 'BUILDING' then 1 else -1 end as target from customer")
def external_targets(spark, folder):
    c = table(spark, folder, "customer").select(F.concat(F.lit("c"), _text("c_custkey")).alias("seq_id"), "c_mktsegment")
    return tabular.split_by_group(c, "c_mktsegment", "BUILDING")[2]


@query(
    "external_groups",
    "select 'positive' as side, count(*) as n from customer where c_mktsegment = 'BUILDING' union all select 'negative', count(*) from customer where c_mktsegment <> 'BUILDING'",
)
def external_groups(spark, folder):
    positive, negative, _ = tabular.split_by_group(table(spark, folder, "customer"), "c_mktsegment", "BUILDING", "c_name")
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(positive, "positive").unionByName(count(negative, "negative"))


@query("motif_subset", "select distinct p_brand as rbp_name, p_name as motif from part where p_brand in (select distinct p_brand from part where p_brand like '%1')")
def motif_subset(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_brand").alias("rbp_name"), F.col("p_name").alias("motif")).distinct()
    names = [r[0] for r in part.filter("rbp_name like '%1'").select("rbp_name").distinct().collect()]
    return gm.resolve_subset(part, "ones", {"ones": names})


_FOLDS = """
rows as (select d.doc_id, l.toxic, l.quality, d.n_chars, ('0x' || substr(md5('0|' || d.doc_id), 1, 8))::bigint % 3 as fold from documents d join labels l using (doc_id)),
majority as (select f.fold, (select arg_max(toxic, n * 2 + (1 - toxic)) from (select toxic, count(*) as n from rows r where r.fold <> f.fold group by toxic)) as guess
             from (select distinct fold from rows) f)
"""


@query(
    "dummy_fold_accuracy",
    "with " + _FOLDS.strip() + " select fold::int as fold, round(avg((toxic = guess)::int::double), 9) as accuracy from rows join majority using (fold) group by fold",
)
def dummy_fold_accuracy(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "n_chars").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")
    scores = learn.cross_validate(rows, "dummy", ["n_chars"], "toxic", "doc_id", 3)
    return spark.createDataFrame([(i, round(x, 9)) for i, x in enumerate(scores)], "fold int, accuracy double")


# fitted trees and lines have no SQL form; tests hold them against known answers
@query("model_fold_scores")
def model_fold_scores(spark, folder):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("chars"), F.size(F.split(text, "\n")).cast("double").alias("lines"),
        F.regexp_count(text, F.lit("[$%&*#]")).cast("double").alias("marks"),
    )
    rows = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    out = [
        (kind, fold, score)
        for kind in ("tree", "linear")
        for fold, score in enumerate(learn.cross_validate(rows, kind, ["chars", "lines", "marks"], "quality", "doc_id", 3))
    ]
    return spark.createDataFrame(out, "model string, fold int, accuracy double")
