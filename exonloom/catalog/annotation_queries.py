"""Annotation filters, transcript structure, neighbours, ranking and novel exons."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.catalog.base import (
    EXONS, FEATURES, INTRONS, TRANSCRIPTS, exons, query, table, transcripts, with_ctes,
)
from exonloom.catalog.interval_queries import SUBTRACT, islands_sql
from exonloom.operators import annotation as an
from exonloom.operators import ranking as rk
from exonloom.operators import sequences as sq
from exonloom.operators.tabular import joined_groups
from exonloom.schemas import SITE_COLUMNS

COORD = 'transcript_id, gene_id, chrom, strand, "start", "end"'


@query(
    "introns_by_transcript",
    with_ctes(EXONS, INTRONS, body=f"""select {COORD}, chrom || '_' || "start" || '_' || "end" as intron_id from introns"""),
)
def introns_by_transcript(spark, folder):
    return an.introns(exons(spark, folder), ["gene_id"])


@query(
    "subfeatures_numbered",
    with_ctes(EXONS, INTRONS, FEATURES, body=f"select {COORD}, feature, number from features"),
)
def subfeatures_numbered(spark, folder):
    return an.subfeatures(exons(spark, folder), ["gene_id"])


def _neighbour_sql() -> str:
    cols = []
    order = """over (partition by transcript_id order by case when strand = '-' then -"start" else "start" end,
                case when strand = '-' then -"end" else "end" end, feature desc)"""
    for k in (1, 2):
        for side, fn in (("upstream", "lag"), ("downstream", "lead")):
            for c in ("start", "end", "feature", "number"):
                cols.append(f'{fn}("{c}", {k}) {order} as {c}_{side}_{k}')
    dist = ", ".join(
        f'case when end_{side}_{k} <= "start" then "start" - end_{side}_{k} + 1 else start_{side}_{k} - "end" + 1 end as distance_{side}_{k}'
        for k in (1, 2) for side in ("upstream", "downstream")
    )
    return f"""
near as (select *, {dist} from (select *, {', '.join(cols)} from features) where feature = 'exon')
"""


NEIGHBOURS = (EXONS, INTRONS, FEATURES, _neighbour_sql())


def _neighbours(spark, folder):
    return an.neighbours(an.subfeatures(exons(spark, folder), ["gene_id"]))


@query("neighbours_level2", with_ctes(*NEIGHBOURS, body="select * from near"))
def neighbours_level2(spark, folder):
    return _neighbours(spark, folder)


@query(
    "edge_exons",
    with_ctes(*NEIGHBOURS, body=f"""select {COORD}, number from near where start_upstream_1 is null
        or start_upstream_2 is null or start_downstream_1 is null or start_downstream_2 is null"""),
)
def edge_exons(spark, folder):
    return an.split_edge_exons(_neighbours(spark, folder))[1].select(
        "transcript_id", "gene_id", "chrom", "strand", "start", "end", "number"
    )


@query(
    "splice_sites",
    with_ctes(EXONS, body="""select transcript_id, gene_id, chrom, strand, s as "start", e as "end" from (
        select *, "start" - 2 as s, "start" as e, row_number() over (partition by transcript_id order by "start", "end") as rn from exons
        union all
        select *, "end", "end" + 2, row_number() over (partition by transcript_id order by "start" desc, "end" desc) from exons) where rn > 1"""),
)
def splice_sites(spark, folder):
    return an.splice_sites(exons(spark, folder))


@query(
    "splice_site_regions",
    with_ctes(EXONS, INTRONS, body="""select transcript_id, gene_id, chrom, strand, region, s as "start", e as "end" from (
        select *, 'donor' as region, case when strand = '-' then "end" - 6 else "start" end as s,
               case when strand = '-' then "end" else "start" + 6 end as e from introns
        union all
        select *, 'acceptor', case when strand = '-' then "start" else "end" - 20 end,
               case when strand = '-' then "start" + 20 else "end" end from introns)"""),
)
def splice_site_regions(spark, folder):
    gaps = an.introns(exons(spark, folder), ["gene_id"]).drop("intron_id")
    return an.splice_site_regions(gaps, five=6, three=20)


@query(
    "merged_exons_by_gene",
    with_ctes(EXONS, body="""select chrom, strand, gene_id, min("start") as "start", max("end") as "end", count(*) as n_merged from (
        select *, sum(head) over (partition by gene_id order by "start", "end", transcript_id rows unbounded preceding) as grp from (
          select *, case when "start" <= max("end") over (partition by gene_id order by "start", "end", transcript_id
                 rows between unbounded preceding and 1 preceding) then 0 else 1 end as head from exons))
        group by chrom, strand, gene_id, grp"""),
)
def merged_exons_by_gene(spark, folder):
    return an.merged_exons(exons(spark, folder))


@query(
    "inverse_coordinates",
    with_ctes(
        EXONS, TRANSCRIPTS,
        "a as (select transcript_id, gene_id, chrom, strand, \"start\", \"end\" from transcripts)",
        islands_sql("exons", "chrom", '"start", "end", transcript_id'),
        SUBTRACT.format(k="chrom", id="transcript_id", cols="transcript_id, gene_id, chrom, strand"),
        body="""select transcript_id, gene_id, chrom, strand, s2 as "start", e2 as "end" from (
          select *, s + case when strand = '+' then 20 else 30 end as s2, e - case when strand = '+' then 30 else 20 end as e2
          from pieces where s < e) where s2 < e2""",
    ),
)
def inverse_coordinates(spark, folder):
    tx = transcripts(spark, folder).select("transcript_id", "gene_id", "chrom", "strand", "start", "end")
    return an.inverse_coordinates(tx, exons(spark, folder), shrink_five=20, shrink_three=30)


@query(
    "coordinates_with_ids",
    with_ctes(EXONS, body="""select chrom, "start", "end", string_agg(distinct transcript_id, ',' order by transcript_id) as transcript_ids
        from exons group by chrom, "start", "end" """),
)
def coordinates_with_ids(spark, folder):
    return an.coordinates_with_ids(exons(spark, folder), ["chrom", "start", "end"], "transcript_id")


_WEIGHTS = "weights(tag_name, w) as (values " + ", ".join(
    f"('{t}', {w})" for t, w in rk.TAG_WEIGHTS.items()
) + ")"

SCORED = """
scored as (
  select t.*, coalesce(x.score, -1) as rank_score from transcripts t left join (
    select transcript_id, cast(sum(coalesce(w, 0)) as bigint) as score from (
      select transcript_id, unnest(string_split(tag, ';')) as tag_name from transcripts) left join weights using (tag_name)
    group by transcript_id) x on t.transcript_id = x.transcript_id)
"""


@query(
    "tag_score",
    with_ctes(EXONS, TRANSCRIPTS, _WEIGHTS, SCORED, body="select transcript_id, tag, rank_score from scored"),
)
def tag_score(spark, folder):
    return rk.rank_transcripts(transcripts(spark, folder)).select("transcript_id", "tag", "rank_score")


@query(
    "top_transcript_per_gene",
    with_ctes(EXONS, TRANSCRIPTS, _WEIGHTS, SCORED, body="""select gene_id, transcript_id, rank_score from scored
        qualify row_number() over (partition by gene_id order by rank_score desc, "end" - "start" desc, transcript_id) = 1"""),
)
def top_transcript_per_gene(spark, folder):
    return rk.rank_transcripts(transcripts(spark, folder), top_only=True).select(
        "gene_id", "transcript_id", "rank_score"
    )


@query(
    "top_rank_with_ties",
    with_ctes(EXONS, TRANSCRIPTS, _WEIGHTS, SCORED, body="""select gene_id, transcript_id, rank_score from scored
        qualify rank_score = max(rank_score) over (partition by gene_id)"""),
)
def top_rank_with_ties(spark, folder):
    scored = rk.rank_transcripts(transcripts(spark, folder))
    return rk.top_ties(scored, ["gene_id"], "rank_score").select("gene_id", "transcript_id", "rank_score")


@query(
    "biotype_filter",
    with_ctes(EXONS, TRANSCRIPTS, body="select transcript_id, transcript_type from transcripts where transcript_type in ('O', 'F')"),
)
def biotype_filter(spark, folder):
    return an.filter_biotypes(transcripts(spark, folder), "transcript_type", ["O", "F"]).select(
        "transcript_id", "transcript_type"
    )


@query(
    "biotype_matrix",
    with_ctes(EXONS, TRANSCRIPTS, body="select transcript_type, " + ", ".join(
        f"count(*) filter (gene_type = 'c{i}') as c{i}" for i in range(4)
    ) + " from transcripts group by transcript_type"),
)
def biotype_matrix(spark, folder):
    return an.biotype_matrix(transcripts(spark, folder), [f"c{i}" for i in range(4)])


@query(
    "id_filters",
    with_ctes(EXONS, TRANSCRIPTS, body="""select transcript_id, gene_id from transcripts
        where gene_id in (select 'g' || p_partkey from part) and transcript_id in (select 't' || o_orderkey from orders where o_totalprice > 100000)"""),
)
def id_filters(spark, folder):
    genes = table(spark, folder, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")))
    wanted = table(spark, folder, "orders").filter("o_totalprice > 100000").select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))
    )
    return an.filter_ids(transcripts(spark, folder), genes=genes, transcripts=wanted).select(
        "transcript_id", "gene_id"
    )


@query(
    "strip_versions",
    "select 'G' || o_custkey as gene_id, 'T' || o_orderkey as transcript_id, o_orderstatus as exon_id from orders",
)
def strip_versions(spark, folder):
    text = lambda c: F.col(c).cast("string")
    df = table(spark, folder, "orders").select(
        F.concat(F.lit("G"), text("o_custkey"), F.lit(".7")).alias("gene_id"),
        F.concat(F.lit("T"), text("o_orderkey"), F.lit(".1.2")).alias("transcript_id"),
        F.col("o_orderstatus").alias("exon_id"),
    )
    return an.strip_versions(df)


# customers are genes with one row per order; two 'gene' rows mean a sex-chromosome duplicate
@query(
    "sex_duplicates_removed",
    """with r as (select 'g' || o_custkey as gene_id, case when o_orderkey % 5 = 0 then 'gene' else 'exon' end as feature,
          case when o_orderkey % 2 = 0 then 'chrX' else 'chrY' end as chrom, o_orderkey as id from orders)
       select * from r where not (chrom = 'chrY' and gene_id in (
          select gene_id from r where feature = 'gene' group by gene_id having count(*) > 1))""",
)
def sex_duplicates_removed(spark, folder):
    df = table(spark, folder, "orders").select(
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("gene_id"),
        F.when(F.col("o_orderkey") % 5 == 0, "gene").otherwise("exon").alias("feature"),
        F.when(F.col("o_orderkey") % 2 == 0, "chrX").otherwise("chrY").alias("chrom"),
        F.col("o_orderkey").alias("id"),
    )
    return an.drop_sex_duplicates(df)


# every order asks for the exon of its first line number; half of the requests are shifted away
_TARGETS = """
targets as (
  select 'g' || (l_orderkey // 5) as gene_id, 'chr' || ((l_orderkey // 5) % 22 + 1) as chrom,
         case when (l_orderkey // 5) % 2 = 0 then '+' else '-' end as strand,
         (l_orderkey // 5) * 10000 + l_linenumber * 1000 + min(l_partkey) % 300 + (l_orderkey % 2) as "start",
         (l_orderkey // 5) * 10000 + l_linenumber * 1000 + min(l_partkey) % 300 + 50
           + cast(max(l_quantity) * 5 as bigint) as "end", 'e' || l_orderkey || '_' || l_linenumber as name
  from lineitem group by l_orderkey, l_linenumber)
"""


def _targets(spark, folder):
    number = F.substr("transcript_id", F.lit(2)).cast("bigint")
    gene = F.substr("gene_id", F.lit(2)).cast("bigint")
    line = F.floor((F.col("start") - gene * 10000) / 1000).cast("string")
    return exons(spark, folder).select(
        "gene_id", "chrom", "strand", (F.col("start") + number % 2).alias("start"), "end",
        F.concat(F.lit("e"), number.cast("string"), F.lit("_"), line).alias("name"),
    )


def _cache(spark, folder):
    scored = rk.rank_transcripts(transcripts(spark, folder)).select("transcript_id", "rank_score")
    return exons(spark, folder).join(scored, "transcript_id")


_CACHE_SQL = (EXONS, TRANSCRIPTS, _WEIGHTS, SCORED, _TARGETS,
              "cache as (select e.*, s.rank_score from exons e join scored s on e.transcript_id = s.transcript_id)")


@query(
    "annotate_known",
    with_ctes(*_CACHE_SQL, body="""select t.name, t.gene_id, t.chrom, t.strand, t."start", t."end", c.transcript_id, c.rank_score
        from targets t join cache c on t.chrom = c.chrom and t."start" = c."start" and t."end" = c."end" and t.strand = c.strand and t.gene_id = c.gene_id
        qualify row_number() over (partition by t.name order by c.rank_score desc, c.transcript_id) = 1"""),
)
def annotate_known(spark, folder):
    known, _ = an.annotate_by_key(_targets(spark, folder), _cache(spark, folder))
    return an.top_known(known, ["name"], ["transcript_id"])


@query(
    "annotate_absent",
    with_ctes(*_CACHE_SQL, body="""select * from targets t where not exists (select 1 from cache c where t.chrom = c.chrom
        and t."start" = c."start" and t."end" = c."end" and t.strand = c.strand and t.gene_id = c.gene_id)"""),
)
def annotate_absent(spark, folder):
    return an.annotate_by_key(_targets(spark, folder), _cache(spark, folder))[1]


# codons inside the first and last exon of two transcripts in three
def _codon_rows(spark, folder):
    ex = exons(spark, folder)
    tx = ex.groupBy("transcript_id", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    num = F.substr("transcript_id", F.lit(2)).cast("bigint")
    codon = tx.filter(num % 3 != 0)
    minus = F.col("strand") == "-"
    five, three = ("start_codon", "stop_codon")
    left = codon.select("transcript_id", "chrom", "strand", (F.col("start") + 12).alias("start"), (F.col("start") + 15).alias("end"),
                        F.when(minus, three).otherwise(five).alias("feature"))
    right = codon.select("transcript_id", "chrom", "strand", (F.col("end") - 21).alias("start"), (F.col("end") - 18).alias("end"),
                         F.when(minus, five).otherwise(three).alias("feature"))
    body = ex.select("transcript_id", "chrom", "strand", "start", "end")
    return (
        tx.withColumn("feature", F.lit("transcript"))
        .unionByName(left).unionByName(right)
        .unionByName(body.withColumn("feature", F.lit("exon")))
        .unionByName(body.filter("start % 2 = 0").withColumn("feature", F.lit("CDS")))
    )


_REGIONS = """
tx as (select transcript_id, chrom, strand, min("start") as ts, max("end") as te from exons group by all),
codons as (select * from tx where cast(substr(transcript_id, 2) as bigint) % 3 <> 0),
utrs as (
  select transcript_id, chrom, strand, case when strand = '-' then 'utr3' else 'utr5' end as region, ts as s,
         case when strand = '-' then ts + 12 else ts + 12 end as e from codons
  union all
  select transcript_id, chrom, strand, case when strand = '-' then 'utr5' else 'utr3' end,
         te - 18, te from codons),
gap as (select transcript_id, chrom, strand, "start" as s, "end" as e from introns i where not exists (
   select 1 from utrs u where u.transcript_id = i.transcript_id and u.s < i."end" and i."start" < u.e)),
parts as (
  select * from utrs
  union all select transcript_id, chrom, strand, 'exon', "start", "end" from exons
  union all select transcript_id, chrom, strand, 'CDS', "start", "end" from exons where "start" % 2 = 0
  union all select transcript_id, chrom, strand, 'intron', s, e from gap)
"""


@query(
    "labelled_regions",
    with_ctes(EXONS, INTRONS, _REGIONS, body="""select chrom, s as "start", e as "end", region || '_' || transcript_id as name, strand,
        row_number() over (partition by transcript_id, region order by case when strand = '-' then -s else s end) as score from parts"""),
)
def labelled_regions(spark, folder):
    return an.labelled_regions(an.region_arrays(_codon_rows(spark, folder)))


@query(
    "introns_in_utr",
    with_ctes(EXONS, INTRONS, _REGIONS, body="""select i.transcript_id, i."start", i."end",
        case when u.s is null then 'no_utr5' when u.s < i."end" and i."start" < u.e then 'True' else 'False' end as in_utr5
        from introns i left join (select * from utrs where region = 'utr5') u on i.transcript_id = u.transcript_id"""),
)
def introns_in_utr(spark, folder):
    regions = an.region_arrays(_codon_rows(spark, folder))
    gaps = an.introns(exons(spark, folder))
    return an.tag_introns_in_utr(gaps, regions, "utr5").select("transcript_id", "start", "end", "in_utr5")


@query(
    "attribute_arrays",
    with_ctes(EXONS, INTRONS, FEATURES, body="""select transcript_id,
        string_agg(cast("end" - "start" as varchar), ';' order by number) filter (feature = 'exon') as length_exon,
        coalesce(string_agg(cast("end" - "start" as varchar), ';' order by number) filter (feature = 'intron'), '') as length_intron
        from features group by transcript_id"""),
)
def attribute_arrays(spark, folder):
    features = an.add_length(an.subfeatures(exons(spark, folder)))
    arrays = an.attribute_arrays(features, ["length"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)
    return arrays.select("transcript_id", text("length_exon"), text("length_intron"))


@query(
    "explode_aligned",
    with_ctes(EXONS, INTRONS, FEATURES, body="""select transcript_id, number, "start", "end" - "start" as length
        from features where feature = 'exon'"""),
)
def explode_aligned(spark, folder):
    features = an.add_length(an.subfeatures(exons(spark, folder)))
    arrays = an.attribute_arrays(features, ["start", "length"])
    return an.explode_arrays(arrays, ["transcript_id"], {"start": "start_exon", "length": "length_exon"})


@query(
    "base_class_marks",
    with_ctes(EXONS, """
        p as (select *, row_number() over w as n, count(*) over (partition by transcript_id) as k,
              min("start") over (partition by transcript_id) as lo, max("end") over (partition by transcript_id) as hi
              from exons window w as (partition by transcript_id order by case when strand = '-' then -"end" else "start" end)),
        q as (select transcript_id, n, k, case when strand = '-' then hi - "end" else "start" - lo end as f,
              case when strand = '-' then hi - "start" else "end" - lo end - 1 as l from p)""",
        body="""select transcript_id, f - 2 + d as pos, 2 as class from q, (values (0), (1)) v(d) where n > 1
        union all select transcript_id, l + 1 + d, 1 from q, (values (0), (1)) v(d) where n < k"""),
)
def base_class_marks(spark, folder):
    return an.base_class_marks(exons(spark, folder))


# one candidate exon per order, somewhere inside its gene
_NOVEL = """
novel as (
  select 'n' || o_orderkey as exon_id, 'g' || (o_orderkey // 5) as gene_id, 'chr' || ((o_orderkey // 5) % 22 + 1) as chrom,
         case when (o_orderkey // 5) % 2 = 0 then '+' else '-' end as strand,
         (o_orderkey // 5) * 10000 + (o_custkey * 37) % 8000 as "start", (o_orderkey // 5) * 10000 + (o_custkey * 37) % 8000 + 60 as "end"
  from orders)
"""


def _novel(spark, folder):
    gene = F.floor(F.col("o_orderkey") / F.lit(5)).cast("bigint")
    start = gene * 10000 + (F.col("o_custkey") * 37) % 8000
    return table(spark, folder, "orders").select(
        F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("exon_id"),
        F.concat(F.lit("g"), gene.cast("string")).alias("gene_id"),
        F.concat(F.lit("chr"), (gene % 22 + 1).cast("string")).alias("chrom"),
        F.when(gene % 2 == 0, "+").otherwise("-").alias("strand"),
        start.alias("start"), (start + 60).alias("end"),
    )


_FITS = """
fits as (
  select * from (
    select n.*, c.transcript_id, c.rank_score, min(c."start") as lo, max(c."end") as hi,
           max(case when c."end" <= n."start" then c."end" end) as be, min(case when c."start" >= n."end" then c."start" end) as af
    from novel n join cache c on n.gene_id = c.gene_id group by all)
  where lo < "end" and "start" < hi and be < "start" and af > "end")
"""


@query(
    "insert_novel_exons",
    with_ctes(*_CACHE_SQL, _NOVEL, _FITS, """
        best as (select * from fits qualify row_number() over (partition by exon_id order by rank_score desc, transcript_id) = 1)""",
        body="""select b.exon_id, b.gene_id, b.transcript_id as base_transcript_id, b.rank_score, b."start", b."end",
          1 + (select count(*) from cache c where c.transcript_id = b.transcript_id and
               case when b.strand = '-' then c."start" >= b.af else c."end" <= b.be end) as number from best b"""),
)
def insert_novel_exons(spark, folder):
    inserted, _, _ = an.insert_exons(_novel(spark, folder), _cache(spark, folder))
    return inserted.select("exon_id", "gene_id", "base_transcript_id", "rank_score", "start", "end", "number")


@query(
    "novel_exons_discarded",
    with_ctes(*_CACHE_SQL, _NOVEL, _FITS, body="select * from novel where exon_id not in (select exon_id from fits)"),
)
def novel_exons_discarded(spark, folder):
    return an.insert_exons(_novel(spark, folder), _cache(spark, folder))[2]


@query(
    "novel_exon_structures",
    with_ctes(*_CACHE_SQL, _NOVEL, _FITS, """
        body as (select f.exon_id, f.transcript_id, c."start", c."end" from fits f join cache c on f.transcript_id = c.transcript_id
                 where c."end" <= f.be or c."start" >= f.af
                 union all select exon_id, transcript_id, "start", "end" from fits)""",
        body="""select transcript_id || '_' || substr(md5(exon_id), 1, 8) as transcript_id, count(*) as n_exons, cast(sum("end" - "start") as bigint) as exonic
                from body group by exon_id, transcript_id"""),
)
def novel_exon_structures(spark, folder):
    _, structures, _ = an.insert_exons(_novel(spark, folder), _cache(spark, folder), top_only=False)
    ex = structures.filter("feature = 'exon'")
    return ex.groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("n_exons"), F.sum(F.col("end") - F.col("start")).alias("exonic")
    )


def _site_sql(o: str, e: str, fixed: bool) -> str:
    """Site columns of the window [o, e) as SQL over ``near``."""
    seen = lambda c: f"case when {c} >= {o} and {c} <= {e} then {c} end" if fixed else c
    out = []
    for i, (s, t) in enumerate((("start_upstream_2", "end_upstream_2"), ('"start"', '"end"'), ("start_downstream_2", "end_downstream_2"))):
        out.append(f"case when strand = '+' then {seen(s)} - ({o}) else ({e}) - {seen(t)} end as {SITE_COLUMNS[2 * i]}")
        out.append(f"case when strand = '+' then {seen(t)} - ({o}) else ({e}) - {seen(s)} end - 1 as {SITE_COLUMNS[2 * i + 1]}")
    return ", ".join(out)


_HEADER = "chrom || ':' || (({o}) + 1) || '-' || ({e}) || '(' || strand || ')_' || transcript_id as seq_id"


def _window_sql(o, e, fixed):
    return with_ctes(*NEIGHBOURS, body=f"""select {_HEADER.format(o=o, e=e)}, {_site_sql(o, e, fixed)} from near
        where start_upstream_1 is not null and start_upstream_2 is not null and start_downstream_1 is not null and start_downstream_2 is not null""")


@query("fixed_windows", _window_sql('"start" - 1200', '"end" + 1200', True))
def fixed_windows(spark, folder):
    inner, _ = an.split_edge_exons(_neighbours(spark, folder))
    return sq.fixed_windows(inner, reach=1200).select("seq_id", *SITE_COLUMNS)


_FULL_START = "case when strand = '-' then start_downstream_2 else start_upstream_2 end - 100"
_FULL_END = "case when strand = '-' then end_upstream_2 else end_downstream_2 end + 100"


@query("full_windows", _window_sql(_FULL_START, _FULL_END, False))
def full_windows(spark, folder):
    inner, _ = an.split_edge_exons(_neighbours(spark, folder))
    return sq.full_windows(inner, border=100).select("seq_id", *SITE_COLUMNS)


@query(
    "string_agg",
    """select o_custkey as custkey, string_agg(o_orderpriority, ',' order by o_orderkey) as groups,
              string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as orders from orders group by o_custkey""",
)
def string_agg(spark, folder):
    df = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("groups"), F.col("o_orderkey").alias("orders")
    )
    return joined_groups(df, ["custkey"], ["groups", "orders"], ["orders"])


@query(
    "argmax_abs",
    """select c_nationkey as nation, c_custkey as custkey, c_acctbal as acctbal from customer
       qualify row_number() over (partition by c_nationkey order by abs(c_acctbal) desc, c_custkey) = 1""",
)
def argmax_abs(spark, folder):
    df = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal")
    )
    return rk.argmax_abs(df, ["nation"], "acctbal", ["custkey"])


@query(
    "argmin_abs",
    """select c_mktsegment as segment, c_custkey as custkey, c_acctbal as acctbal from customer
       qualify row_number() over (partition by c_mktsegment order by abs(c_acctbal), c_custkey) = 1""",
)
def argmin_abs(spark, folder):
    df = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal")
    )
    return rk.argmax_abs(df, ["segment"], "acctbal", ["custkey"], smallest=True)


@query(
    "best_row_per_key",
    """select p_brand as brand, p_partkey as partkey, p_retailprice as price from part
       qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1""",
)
def best_row_per_key(spark, folder):
    df = table(spark, folder, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), F.col("p_retailprice").alias("price")
    )
    return rk.best_row(df, ["brand"], "price", ["partkey"])
