"""Scores, realignment, variable positions and effects; embeddings serve as score tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.catalog.base import SEQS, query, sequences, table, with_ctes
from exonloom.operators import predict as pr
from exonloom.operators import tabular as tb
from exonloom.schemas import SITE_COLUMNS

# A label is a sequence, its first vector the reference and the others its deletion mutants.
SCORES = """
base as (
  select vec_id, 'v' || vec_id as id, 'g' || label as seq_id, min(vec_id) over (partition by label) as ref_id,
         list_transform(embedding, lambda x: 3 * abs(x::double)) as acceptor, list_reverse(list_transform(embedding, lambda x: 3 * abs(x::double))) as donor,
         vec_id % 30 + 5 as "start", vec_id % 30 + 6 + vec_id % 4 as "end" from embeddings),
refs as (select seq_id, acceptor, donor from base where vec_id = ref_id),
muts as (select id, seq_id, 'DEL' as type, "start", "end", acceptor[1:64 - ("end" - "start")] as acceptor, donor[1:64 - ("end" - "start")] as donor
         from base where vec_id <> ref_id),
aligned as (
  select id, seq_id, type, "start", "end",
    list_concat(list_concat(acceptor[1:"start"], list_transform(range("end" - "start"), lambda x: 0.0::double)), acceptor["start" + 1:]) as acceptor,
    list_concat(list_concat(donor[1:"start"], list_transform(range("end" - "start"), lambda x: 0.0::double)), donor["start" + 1:]) as donor from muts),
site as (
  select distinct seq_id, 2 + k % 3 as start_exon_upstream, 8 as end_exon_upstream, 20 + k as start_exon_cassette, 35 as end_exon_cassette,
    case when k % 4 <> 0 then 45 end as start_exon_downstream, case when k % 4 <> 0 then 60 end as end_exon_downstream
  from (select seq_id, cast(substr(seq_id, 2) as bigint) as k from base)),
long as (
  select id, seq_id, unnest(range(64)) as pos, unnest(acceptor) as a, unnest(donor) as d from (
    select id, seq_id, acceptor, donor from aligned union all select seq_id || '_ref', seq_id, acceptor, donor from refs)),
spans as (select seq_id, pos, max(a) - min(a) as ra, max(d) - min(d) as rd, median(a) as ma, median(d) as md from long group by all),
var as (select seq_id, pos, case when ra > {t} and rd > {t} then case when ma >= md then 'acceptor' else 'donor' end
        when ra > {t} then 'acceptor' else 'donor' end as site from spans where ra > {t} or rd > {t})
"""
THRESHOLD = 1.15


def _base(spark, folder):
    e = table(spark, folder, "embeddings")
    scores = F.transform("embedding", lambda x: F.lit(3) * F.abs(x.cast("double")))
    first = e.groupBy("label").agg(F.min("vec_id").alias("ref_id"))
    start = F.col("vec_id") % 30 + 5
    return e.join(first, "label").select(
        "vec_id", "ref_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
        F.concat(F.lit("g"), F.col("label").cast("string")).alias("seq_id"),
        scores.alias("acceptor"), F.reverse(scores).alias("donor"),
        start.alias("start"), (start + 1 + F.col("vec_id") % 4).alias("end"),
    )


def _references(spark, folder):
    return _base(spark, folder).filter("vec_id = ref_id").select("seq_id", "acceptor", "donor")


def _mutants(spark, folder):
    """Mutants with scores in their own (shorter) coordinates."""
    keep = (F.lit(64) - (F.col("end") - F.col("start"))).cast("int")
    return _base(spark, folder).filter("vec_id <> ref_id").select(
        "id", "seq_id", F.lit("DEL").alias("type"), "start", "end",
        F.slice("acceptor", F.lit(1), keep).alias("acceptor"), F.slice("donor", F.lit(1), keep).alias("donor"),
    )


def _sites(spark, folder):
    k = F.substr("seq_id", F.lit(2)).cast("bigint")
    n = lambda v: F.lit(v).cast("bigint")
    down = k % 4 != 0
    values = [2 + k % 3, n(8), 20 + k, n(35), F.when(down, n(45)), F.when(down, n(60))]
    return _base(spark, folder).select("seq_id").distinct().select(
        "seq_id", *[v.alias(c) for c, v in zip(SITE_COLUMNS, values)]
    )


def _everything(spark, folder):
    refs = _references(spark, folder).select("seq_id", F.concat("seq_id", F.lit("_ref")).alias("id"), "acceptor", "donor")
    return pr.realign(_mutants(spark, folder)).select("seq_id", "id", "acceptor", "donor").unionByName(refs)


def _sql(body: str, *more: str, threshold: float = THRESHOLD) -> str:
    return with_ctes(SCORES.format(t=threshold), *more, body=body)


@query("realigned_scores", _sql("""select id, unnest(range(64)) as pos, unnest(acceptor) as acceptor, unnest(donor) as donor from aligned"""))
def realigned_scores(spark, folder):
    return pr.explode_scores(pr.realign(_mutants(spark, folder)), ["id"])


@query("realigned_scores_long", _sql("""select id as seq_id, unnest(range(64)) as pos, unnest(acceptor) as acceptor, unnest(donor) as donor from aligned"""))
def realigned_scores_long(spark, folder):
    muts = _mutants(spark, folder)
    long = pr.explode_scores(muts.withColumn("seq_id", F.col("id")))
    return pr.realign_long(long, muts.select("id", "start", "end"))


@query(
    "sites_after_deletion",
    _sql("select id, " + ", ".join(
        f"case when {c} between \"start\" and \"end\" then \"start\" when {c} > \"end\" then case when {c} - (\"end\" - \"start\") >= 0 then {c} - (\"end\" - \"start\") end else {c} end as {c}"
        for c in SITE_COLUMNS
    ) + " from muts join site using (seq_id)"),
)
def sites_after_deletion(spark, folder):
    joined = _mutants(spark, folder).join(_sites(spark, folder), "seq_id")
    return pr.shift_sites(joined).select("id", *SITE_COLUMNS)


@query(
    "reference_sites",
    _sql("""select seq_id,
      array_to_string(list_transform(list_filter(range(64), lambda i: acceptor[i + 1] > 0.8), lambda i: i), ';') as acceptor_idx,
      array_to_string(list_transform(list_filter(range(64), lambda i: donor[i + 1] > 0.8), lambda i: i), ';') as donor_idx,
      coalesce(list_sum(list_transform(list_filter(range(64), lambda i: acceptor[i + 1] > 0.8), lambda i: round(acceptor[i + 1], 3))), 0) as acceptor_sum from refs"""),
)
def reference_sites(spark, folder):
    found = pr.reference_sites(_references(spark, folder), 0.8)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)
    total = F.aggregate("acceptor_preds", F.lit(0.0), lambda a, x: a + x)
    return found.select("seq_id", text("acceptor_idx"), text("donor_idx"), total.alias("acceptor_sum"))


@query("variable_positions", _sql("select * from var"))
def variable_positions(spark, folder):
    return pr.variable_positions(_everything(spark, folder), threshold=THRESHOLD)


@query(
    "variable_tracks",
    _sql("""select l.seq_id, l.id, l.pos, v.site, case when v.site = 'acceptor' then a else d end as score
            from long l join var v on l.seq_id = v.seq_id and l.pos = v.pos"""),
)
def variable_tracks(spark, folder):
    scores = _everything(spark, folder)
    return pr.variable_tracks(scores, pr.variable_positions(scores, threshold=THRESHOLD))


_LISTS = """
lists as (select seq_id, list(pos order by pos) filter (site = 'acceptor') as va, list(pos order by pos) filter (site = 'donor') as vd from var group by seq_id),
j as (
  select m.*, r.acceptor as ra, r.donor as rd, s.* exclude (seq_id), coalesce(va, []) as va, coalesce(vd, []) as vd,
    [x for x in [start_exon_upstream, end_exon_upstream, start_exon_cassette, end_exon_cassette, start_exon_downstream, end_exon_downstream] if x is not null] as known
  from aligned m join refs r on m.seq_id = r.seq_id join site s on m.seq_id = s.seq_id left join lists l on m.seq_id = l.seq_id)
"""


def _effects_sql() -> str:
    cols = []
    for i, side in enumerate(("upstream", "cassette", "downstream")):
        for kind, m, r, v, c in (("acceptor", "acceptor", "ra", "va", SITE_COLUMNS[2 * i]), ("donor", "donor", "rd", "vd", SITE_COLUMNS[2 * i + 1])):
            cols.append(f"{m}[{c} + 1] as ref_{kind}_{side}")
            cols.append(f"case when list_contains({v}, {c}) then round({m}[{c} + 1] - {r}[{c} + 1], 3) else 0 end as {kind}_{side}_effect")
    shift = "case when p between \"start\" and \"end\" then '' when p > \"end\" then cast(p - (\"end\" - \"start\") as varchar) else cast(p as varchar) end"
    for kind, m, r, v in (("acceptor", "acceptor", "ra", "va"), ("donor", "donor", "rd", "vd")):
        changed = f"list_filter({v}, lambda p: not list_contains(known, p) and abs(round({m}[p + 1] - {r}[p + 1], 3)) > 0.2)"
        cols.append(f"array_to_string(list_transform(list_filter(range(64), lambda p: {m}[p + 1] > 1.2 and not list_contains(known, p)), lambda p: {shift}), ';') as other_{kind}_position")
        cols.append(f"array_to_string(list_transform({changed}, lambda p: {shift}), ';') as other_{kind}_affected_position")
        cols.append(f"coalesce(list_sum(list_transform({changed}, lambda p: round({m}[p + 1] - {r}[p + 1], 3))), 0) as other_{kind}_effect")
        cols.append(f"coalesce(list_sum(list_transform({changed}, lambda p: case when \"start\" < p and p < \"end\" then 0 else least(abs(p - \"start\"), abs(p - \"end\")) end)), 0)::bigint as other_{kind}_distance")
    return "summary as (select id, seq_id, " + ", ".join(cols) + " from j)"


def _summary(spark, folder):
    return pr.effect_summary(
        pr.realign(_mutants(spark, folder)), _references(spark, folder), _sites(spark, folder), THRESHOLD,
    )


@query("effect_summary", _sql("select * from summary", _LISTS, _effects_sql().replace("> 1.2 and", "> 0.2 and")))
def effect_summary(spark, folder):
    out = _summary(spark, folder)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ";").alias(c)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias(c)
    cols = ["id", "seq_id"]
    for side in ("upstream", "cassette", "downstream"):
        cols += [f"{p}" for k in ("acceptor", "donor") for p in (f"ref_{k}_{side}", f"{k}_{side}_effect")]
    for k in ("acceptor", "donor"):
        cols += [
            text(f"other_{k}_position"), text(f"other_{k}_affected_position"), total(f"other_{k}_effect"),
            F.aggregate(f"other_{k}_distance_to_mutation", F.lit(0).cast("bigint"), lambda a, x: a + x).alias(f"other_{k}_distance"),
        ]
    return out.select(*cols)


_EFFECTS = ("acceptor_cassette_effect", "donor_cassette_effect")
_SIGNIFICANT = """
fx as (select id, seq_id, acceptor_cassette_effect, donor_cassette_effect from summary),
sig as (select *, case when abs(donor_cassette_effect) > abs(acceptor_cassette_effect) then donor_cassette_effect else acceptor_cassette_effect end as effect
        from fx where abs(acceptor_cassette_effect) >= 0.05 or abs(donor_cassette_effect) >= 0.05)
"""


def _effects(body: str) -> str:
    return _sql(body, _LISTS, _effects_sql().replace("> 1.2 and", "> 0.2 and"), _SIGNIFICANT)


def _bin_sql(v: str) -> str:
    return "case " + " ".join(
        f"when {v} > {lo} and {v} <= {hi} then '{label}'" for lo, hi, label in zip(pr.EFFECT_EDGES, pr.EFFECT_EDGES[1:], pr.EFFECT_LABELS)
    ) + " end"


def _simple(spark, folder):
    return _summary(spark, folder).select("id", "seq_id", *_EFFECTS)


@query(
    "significant_top50",
    _effects(f"select *, {_bin_sql('effect')} as effect_bin from sig order by effect desc, id limit 50"),
)
def significant_top50(spark, folder):
    return pr.significant(_simple(spark, folder))


@query(
    "significant_same_sign",
    _effects(f"""select * exclude (effect), (acceptor_cassette_effect + donor_cassette_effect) / 2 as effect,
        {_bin_sql('(acceptor_cassette_effect + donor_cassette_effect) / 2')} as effect_bin from sig
        where sign(acceptor_cassette_effect) = sign(donor_cassette_effect) and acceptor_cassette_effect <> 0"""),
)
def significant_same_sign(spark, folder):
    return pr.significant(_simple(spark, folder), same_sign=True, use_max=False, top=None)


@query(
    "effect_bins",
    _effects(f"select seq_id, {_bin_sql('effect')} as effect_bin, count(*) as n from sig group by all"),
)
def effect_bins(spark, folder):
    return pr.significant(_simple(spark, folder), top=None).groupBy("seq_id", "effect_bin").agg(F.count(F.lit(1)).alias("n"))


def _independent_sql() -> str:
    cols = ["seq_id"]
    for kind, off in (("acceptor", 0), ("donor", 1)):
        own = [SITE_COLUMNS[2 * i + off] for i in range(3)]
        cols += [f"{kind}[{c} + 1] as ref_{kind}_{s}" for c, s in zip(own, ("upstream", "cassette", "downstream"))]
        cols.append(
            f"array_to_string(list_filter(range(64), lambda p: {kind}[p + 1] > 0.2 and not coalesce(p in ({', '.join(own)}), false)), ';') as other_{kind}_position"
        )
    return "select " + ", ".join(cols) + " from refs join site using (seq_id)"


@query("independent_summary", _sql(_independent_sql()))
def independent_summary(spark, folder):
    out = pr.independent_summary(_references(spark, folder), _sites(spark, folder))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)
    return out.select(
        "seq_id",
        *[f"ref_{k}_{s}" for k in ("acceptor", "donor") for s in ("upstream", "cassette", "downstream")],
        text("other_acceptor_position"), text("other_donor_position"),
    )


@query(
    "tabular_dataset",
    _sql("""select r.seq_id, acceptor[start_exon_cassette + 1] as ref_acceptor_cassette, donor[end_exon_cassette + 1] as ref_donor_cassette,
            (acceptor[start_exon_cassette + 1] + donor[end_exon_cassette + 1]) / 2 as average_cassette_strength, coalesce(c.n, 0) as n_mutants
            from refs r join site using (seq_id) left join (select seq_id, count(*) as n from muts group by seq_id) c on r.seq_id = c.seq_id"""),
)
def tabular_dataset(spark, folder):
    summary = pr.independent_summary(_references(spark, folder), _sites(spark, folder))
    counts = _mutants(spark, folder).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_mutants"))
    return tb.tabular_dataset(summary, counts).select(
        "seq_id", "ref_acceptor_cassette", "ref_donor_cassette", "average_cassette_strength", "n_mutants"
    )


# the scorer is any function of texts; this one measures G and C around each position
@query(
    "predicted_scores",
    with_ctes(SEQS, """p as (select seq_id, seq, i, substr(seq, greatest(i - 9, 0) + 1, i + 1 - greatest(i - 9, 0)) as l, substr(seq, i + 1, least(i + 10, length(seq)) - i) as r
            from seqs, unnest(range(length(seq))) t(i))""",
        """v as (select seq_id, i, (length(l) - length(translate(l, 'GC', ''))) / length(l) as a, (length(r) - length(translate(r, 'GC', ''))) / length(r) as d from p)""",
        body="""select seq_id, count(*) as n, round(sum(a), 5) as acceptor, round(sum(d), 5) as donor, max(i) filter (a > 0.55) as last_acceptor,
                max(i) filter (d > 0.55) as last_donor from v group by seq_id"""),
)
def predicted_scores(spark, folder):
    scored = pr.explode_scores(pr.predict(sequences(spark, folder), pr.gc_scorer()))
    return scored.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("acceptor"), 5).alias("acceptor"), F.round(F.sum("donor"), 5).alias("donor"),
        F.max(F.when(F.col("acceptor") > 0.55, F.col("pos"))).alias("last_acceptor"), F.max(F.when(F.col("donor") > 0.55, F.col("pos"))).alias("last_donor"),
    )


# a mutant's span stands for the hit, so its distances to the cassette sites come from its place
@query(
    "site_effects",
    _effects("""select id, 'Donor' as splice_site, abs(e - "end") as distance, donor_cassette_effect as effect from placed
        union all select id, 'Acceptor', abs("start" - s), acceptor_cassette_effect from placed""").replace(
        "fx as (", """placed as (select m.id, m."start", m."end", start_exon_cassette as s, end_exon_cassette as e, acceptor_cassette_effect, donor_cassette_effect
        from muts m join site using (seq_id) join summary f on f.id = m.id and f.seq_id = m.seq_id), fx as (""", 1),
)
def site_effects(spark, folder):
    spans = _mutants(spark, folder).select("id", "seq_id", "start", "end")
    df = _simple(spark, folder).join(spans, ["id", "seq_id"]).join(_sites(spark, folder), "seq_id").withColumns(
        {
            "distance_to_cassette_donor": F.abs(F.col("end_exon_cassette") - F.col("end")),
            "distance_to_cassette_acceptor": F.abs(F.col("start") - F.col("start_exon_cassette")),
        }
    )
    return tb.site_effects(df, ["id"])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "score_matrix",
    "select c_nationkey, " + ", ".join(f"max(c_acctbal) filter (c_mktsegment = '{s}') as \"{s}\"" for s in SEGMENTS) + " from customer group by 1",
)
def score_matrix(spark, folder):
    df = table(spark, folder, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    return tb.score_matrix(df, "c_nationkey", "c_mktsegment", "c_acctbal", SEGMENTS)


@query("names_with_counts", "select p_brand, count(*) as n, p_brand || ' (N=' || count(*) || ')' as label from part group by 1")
def names_with_counts(spark, folder):
    return tb.names_with_counts(table(spark, folder, "part").select("p_brand"), "p_brand")


@query(
    "direction_flags",
    """select o_orderkey, o_custkey, more_inclusion from orders left join (
         select c_custkey, case when c_acctbal / 10000 > 0.09 then true else false end as more_inclusion from customer where abs(c_acctbal / 10000) > 0.09) on o_custkey = c_custkey""",
)
def direction_flags(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    pairs = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 10000).alias("dPSI"))
    return tb.mark_direction(orders, pairs, ["o_custkey"])


# the stages of a run on the texts of a table: hits, their reduction and place, deletions, scores, effects
@query("perturbation_chain")
def perturbation_chain(spark, folder):
    from exonloom.catalog.base import dna, motif_table, sites
    from exonloom.plans import perturbation as plan

    seqs = table(spark, folder, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("seq_id"), dna("text").alias("seq"))
    name = F.concat("seq_id", F.lit(":0-"), F.length("seq").cast("string"), F.lit("(+)_t"))
    placed = seqs.join(sites(seqs), "seq_id").withColumn("seq_id", name)
    options = plan.Options(scope=300)
    found = plan.located_hits(placed, motif_table(spark), options)
    scored = plan.scores(placed, found, pr.gc_scorer(), options)
    out = plan.summarise(placed, found, scored, options)
    return out.select("id", "seq_id", "rbp_name", "mutation", "acceptor_cassette_effect", "donor_cassette_effect")
