"""Annotation plans, caches, features of sequences and models, on annotations made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from exonloom.catalog.annotation_queries import _CACHE_SQL, _targets, _WEIGHTS, SCORED, _neighbour_sql
from exonloom.catalog.base import EXONS, FEATURES, INTRONS, SEQS, TRANSCRIPTS, exons, query, sequences, table, transcripts, with_ctes
from exonloom.operators import predict as pr
from exonloom.operators import tabular as tb
from exonloom.plans import annotation_cache as ac
from exonloom.plans import paired
from exonloom.session import cut_lineage, ensure_checkpoint_dir
from exonloom.sources import annotation as ga
from exonloom.sources.sequences import chunk_sequences

_text = lambda c: F.col(c).cast("string")


def _gtf_lines(spark, folder):
    """Transcripts and exons of the test annotation as lines of a GTF file."""
    quoted = lambda key, value: F.concat(F.lit(f'{key} "'), value, F.lit('";'))
    tags = F.array_join(F.transform(F.split("tag", ";"), lambda t: quoted("tag", t)), " ")
    own = F.concat_ws(" ", quoted("gene_id", F.col("gene_id")), quoted("transcript_id", F.col("transcript_id")))
    tx = transcripts(spark, folder).select(
        "chrom", "strand", "start", "end", F.lit("transcript").alias("feature"),
        F.concat_ws(" ", own, quoted("transcript_type", F.col("transcript_type")), tags).alias("attribute"),
    )
    body = exons(spark, folder).select("chrom", "strand", "start", "end", F.lit("exon").alias("feature"), own.alias("attribute"))
    dot = F.lit(".")
    return tx.unionByName(body).select(F.concat_ws(
        "\t", "chrom", F.lit("made"), "feature", (F.col("start") + 1).cast("string"), _text("end"), dot, "strand", dot, "attribute"
    ).alias("value"))


def _place(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}.{name}"


@query(
    "processed_annotation",
    with_ctes(EXONS, TRANSCRIPTS, body="""select 'transcript' as feature, transcript_id, gene_id, chrom, strand, "start", "end", tag, transcript_type from transcripts
        union all select 'exon', transcript_id, gene_id, chrom, strand, "start", "end", null, null from exons"""),
)
def processed_annotation(spark, folder):
    path = _place(spark, "parquet")
    ac.prepare(ga.parse_gtf(_gtf_lines(spark, folder))).write.parquet(path)
    return ga.read_processed(spark, path).select("feature", "transcript_id", "gene_id", "chrom", "strand", "start", "end", "tag", "transcript_type")


_NEAR = (EXONS, TRANSCRIPTS, _WEIGHTS, SCORED, INTRONS, FEATURES, _neighbour_sql())


@query(
    "cached_neighbours",
    with_ctes(*_NEAR, body="""select n.transcript_id, n.gene_id, n.chrom, n.strand, n."start", n."end", n.number, start_upstream_1, end_downstream_1, distance_upstream_1, rank_score
        from near n join scored s on n.transcript_id = s.transcript_id"""),
)
def cached_neighbours(spark, folder):
    gtf, out = _place(spark, "gtf"), _place(spark, "cache")
    _gtf_lines(spark, folder).write.text(gtf, compression="gzip")
    ac.build_cache(spark, gtf, out)
    near = ga.read_cache(spark, f"{out}/neighbours", "exon", 1)
    if [c for c in near.columns if c.endswith("_2")]:
        raise AssertionError("level 1 has no second neighbours")
    return near.select(
        "transcript_id", "gene_id", "chrom", "strand", "start", "end", "number", "start_upstream_1", "end_downstream_1", "distance_upstream_1", "rank_score"
    )


# from the lines to the neighbours of every target that is an exon, without a cache
@query(
    "annotate_direct",
    with_ctes(*_NEAR, _CACHE_SQL[4], body="""select t.name, n.transcript_id, rank_score, n.number, start_upstream_2, end_upstream_1, start_downstream_1, end_downstream_2, distance_downstream_2
        from targets t join near n on t.chrom = n.chrom and t."start" = n."start" and t."end" = n."end" and t.strand = n.strand and t.gene_id = n.gene_id
        join scored s on n.transcript_id = s.transcript_id
        qualify row_number() over (partition by t.name order by rank_score desc, n.transcript_id) = 1"""),
)
def annotate_direct(spark, folder):
    annotation = ac.prepare(ga.parse_gtf(cut_lineage(_gtf_lines(spark, folder))))
    found, _, _ = ac.annotate_direct(_targets(spark, folder), annotation)
    known = ~F.contains("transcript_id", F.lit("_"))  # the others are novel exons put into transcripts
    return found.filter(known).select(
        "name", "transcript_id", "rank_score", "number", "start_upstream_2", "end_upstream_1", "start_downstream_1", "end_downstream_2", "distance_downstream_2"
    )


# customers are exons that orders hit in groups; the cache holds their best transcript
@query(
    "events_with_cache",
    """with sel as (select 'c' || o_custkey as target_coordinates, 'n' || (o_custkey % 50) as gene_name, 'g' || (o_custkey % 50) as gene_id,
                          o_orderstatus || '-' || (o_orderkey % 3) as grp, (o_orderkey % 100) / 100.0 as d, o_orderkey as k from orders),
            wide as (select target_coordinates, gene_name, gene_id, string_agg(grp, ',' order by grp, dtext) as grp, string_agg(dtext, ',' order by grp, dtext) as dpsi
                     from (select *, d::double::varchar as dtext from sel) group by all),
            cache as (select 'c' || c_custkey as target_coordinates, 'n' || (c_custkey % 50) as gene_name, 'g' || (c_custkey % 50) as gene_id, 't' || c_custkey || '-' || i as transcript_id,
                             (c_custkey * 7 + i * 5) % 11 as rank_score, case when (c_custkey + i) % 6 <> 0 then c_custkey + i end as start_upstream_1 from customer, unnest(range(3)) t(i)),
            best as (select w.*, transcript_id, rank_score, start_upstream_1 from wide w join cache using (target_coordinates, gene_name, gene_id)
                     qualify row_number() over (partition by target_coordinates, gene_name, gene_id order by rank_score desc, transcript_id) = 1)
       select target_coordinates, grp as "group", dpsi as "dPSI", transcript_id, rank_score, start_upstream_1 from best where start_upstream_1 is not null""",
)
def events_with_cache(spark, folder):
    o = table(spark, folder, "orders")
    name = lambda letter, key: F.concat(F.lit(letter), key.cast("string"))
    ids = lambda key: [name("c", F.col(key)).alias("target_coordinates"), name("n", F.col(key) % 50).alias("gene_name"), name("g", F.col(key) % 50).alias("gene_id")]
    selected = o.select(*ids("o_custkey"), F.concat("o_orderstatus", F.lit("-"), (F.col("o_orderkey") % 3).cast("string")).alias("group"),
                        (F.col("o_orderkey") % 100 / 100).cast("double").alias("dPSI"))
    c = table(spark, folder, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    cache = c.select(
        *ids("c_custkey"), F.concat(name("t", F.col("c_custkey")), F.lit("-"), _text("i")).alias("transcript_id"),
        ((F.col("c_custkey") * 7 + F.col("i") * 5) % 11).alias("rank_score"),
        F.when((F.col("c_custkey") + F.col("i")) % 6 != 0, F.col("c_custkey") + F.col("i")).alias("start_upstream_1"),
    )
    found = paired.attach_cache(selected, cache)
    return found.select("target_coordinates", "group", "dPSI", "transcript_id", "rank_score", "start_upstream_1")


# documents are chromosomes with a transcript of three exons each
_PLACES = [("1", "2"), ("4", "6"), ("8", "9")]


@query(
    "feature_gc",
    with_ctes(
        SEQS, "x as (select seq_id, seq, length(seq) as n, unnest([(1, 2), (4, 6), (8, 9)]) as p from seqs where length(seq) >= 10)",
        """e as (select seq_id, 'exon' as feature, n * p[1] // 10 as s, n * p[2] // 10 as e, seq from x
            union all select seq_id, 'intron', n * a // 10, n * b // 10, seq from (select distinct seq_id, seq, n from x), (values (2, 4), (6, 8)) v(a, b))""",
        """f as (select *, substr(seq, s + 1, e - s) as part from e)""",
        body="""select seq_id as chrom, feature, s::bigint as "start", e::bigint as "end", case when regexp_matches(part, '[^N]') then
                 round(100.0 * (length(part) - length(translate(part, 'GC', ''))) / length(part), 2) end as gc, length(part)::bigint as length from f""",
    ),
)
def feature_gc(spark, folder):
    seqs = cut_lineage(sequences(spark, folder).filter(F.length("seq") >= 10))
    n = F.length("seq")
    at = F.array(*[F.struct(F.expr(f"cast(length(seq) * {a} div 10 as bigint)").alias("start"), F.expr(f"cast(length(seq) * {b} div 10 as bigint)").alias("end")) for a, b in _PLACES])
    tx = F.concat(F.lit("t"), "seq_id")
    common = [F.col("seq_id").alias("chrom"), F.lit("+").alias("strand"), tx.alias("transcript_id"), F.col("seq_id").alias("gene_id"),
              F.lit(None).cast("string").alias("gene_name"), F.lit("pc").alias("transcript_type"), F.lit(None).cast("string").alias("tag")]
    rows = seqs.select(*common, F.lit("exon").alias("feature"), F.inline(at)).unionByName(
        seqs.select(*common, F.lit("transcript").alias("feature"), F.lit(0).cast("bigint").alias("start"), n.cast("bigint").alias("end"))
    )
    made = ac.features_of(rows, chunk_sequences(seqs, 4096), 4096)
    return made.select("chrom", "feature", "start", "end", "gc", "length")


@query(
    "imputed_features",
    """with v as (select o_orderkey as id, case when o_orderkey % 3 <> 0 then o_totalprice::double end as price, case when o_orderkey % 7 <> 0 then (o_custkey % 100)::double end as cust from orders)
       select id, coalesce(price, (select median(price) from v)) as price, coalesce(cust, (select median(cust) from v)) as cust from v""",
)
def imputed_features(spark, folder):
    o = table(spark, folder, "orders")
    made = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("double")).alias("price"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 100).cast("double")).alias("cust"),
    )
    return tb.impute_median(made, ["price", "cust"])


@query(
    "predicted_ensemble",
    with_ctes(SEQS, """p as (select seq_id, i, substr(seq, greatest(i - 9, 0) + 1, i + 1 - greatest(i - 9, 0)) as l, substr(seq, i + 1, least(i + 10, length(seq)) - i) as r
            from seqs, unnest(range(length(seq))) t(i))""",
        """v as (select seq_id, i, (2 * length(l) - length(translate(l, 'GC', '')) - length(translate(l, 'AG', ''))) / 20.0 as a,
                 (2 * length(r) - length(translate(r, 'GC', '')) - length(translate(r, 'AG', ''))) / 20.0 as d from p)""",
        body="""select seq_id, count(*) as n, round(sum(a), 4)::double as acceptor, round(sum(d), 4)::double as donor, max(i) filter (a > 0.676) as last_acceptor,
                max(i) filter (d > 0.676) as last_donor from v group by seq_id"""),
)
def predicted_ensemble(spark, folder):
    scored = pr.explode_scores(pr.predict(sequences(spark, folder), pr.ensemble_scorer(pr.share_models, 10, "shares")))
    return scored.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("acceptor"), 4).alias("acceptor"), F.round(F.sum("donor"), 4).alias("donor"),
        F.max(F.when(F.col("acceptor") > 0.676, F.col("pos"))).alias("last_acceptor"), F.max(F.when(F.col("donor") > 0.676, F.col("pos"))).alias("last_donor"),
    )
