"""Registered queries of the operators here, with their SQL where SQL can state them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.llm import ann, bpe, codes, decontaminate, divergence, extract, linededup, lm, pieces, simhash, toxicity, urlfilter, warc
from exonloom.session import cut_lineage, ensure_checkpoint_dir

#: Fixed rules of the URL filter query: host, path, verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]

#: The public vocabulary of byte pairs.
BYTE_PAIRS = "/opt/tokenizers/word_bpe_49k.json"
#: The public piece vocabulary.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"))


def remainder(key: str, n: int):
    """crc32 of a key as text, modulo ``n``."""
    return F.crc32(F.col(key).cast("string")) % n


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of every document under word counts and under the recurrent model."""
    out = lm.fit_and_score(table(spark, folder, "documents").select("doc_id", "text"), remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", remainder("doc_id", 7) == 2)


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page; a page's outcome is bad when the document of its number is labelled poor or toxic."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), F.expr("int(quality = 0 or toxic = 1)").alias("bad")
    )
    out = urlfilter.judge(table(spark, folder, "pages"), labels, RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again."""
    known = pieces.load(PIECES)
    rows = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), known, check=True)
    return rows.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "lossless"
    )


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by a model that learns from two thirds of the labelled ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, folder, "labels"), remainder("doc_id", 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.col("toxic").alias("over_threshold"),
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Shared lines dropped from every document."""
    out = linededup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.with_revisits(table(spark, folder, "pages"), "page_id", "url", F.col("html")), path)
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return warc.read_warc(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items whose passages each document holds."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-pair ids of every document, decoded again."""
    known = bpe.load(BYTE_PAIRS)
    rows = bpe.decode(bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), known).drop("text"), known)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Four-byte codes of every vector, with squared errors in units of 1/1024, summed per label too."""
    rows, books = codes.compress(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b)
    found = cut_lineage(rows.select("vec_id", "label", code.alias("code"), error.alias("error")))
    return codes.summed_by(found, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256")
    )


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of every source to its peers, and the terms it uses most beyond its language."""
    return divergence.audit(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_nearest_neighbours, op3_language_model, op4_url_filter, op5_sentencepiece, op6_html_extraction, op7_toxicity,
        op8_line_dedup, op9_warc, op10_decontamination, op11_bpe, op12_vector_codes, op13_source_divergence,
    )
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = f"translate({{}}, '{linededup.UPPER}', '{linededup.LOWER}')"


def _strength(groups: str) -> str:
    return f"""(select 1 / least(greatest(coalesce(
        (sum(n * pow(bad * 1.0 / n - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.5), 0.001), 0.5) - 1
        from {groups} where n > 0 and m > 0 and m < 1)"""


_RULED = " ".join(
    f"when (host = '{h}' or host like '%.{h}') and path like '{p}%' then '{{}}'".format(i)
    for i, (h, p, _) in sorted(enumerate(RULES), key=lambda x: (-len(x[1][0]) - len(x[1][1]), -len(x[1][0])))
)
_TWO = ", ".join(f"'{x}'" for x in urlfilter.TWO_LABEL_SUFFIXES)

ORACLES = {
    "op4_url_filter": f"""
with rests as (
  select page_id, case when strpos(url, '://') > 0
    then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
parts as (
  select page_id, {_FOLD.format("regexp_extract(rest, '^[^/]*')")} as host,
         case when strpos(rest, '/') > 0 then substr(rest, strpos(rest, '/')) else '' end as path from rests),
label as (select doc_id, max(cast(quality = 0 or toxic = 1 as bigint)) as bad from labels
          where (quality = 0 or toxic = 1) is not null group by doc_id),
counted as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as l
  from parts left join label on page_id = doc_id group by host),
cut as (select *, array_to_string(l[-2:], '.') in ({_TWO}) as long from counted),
hosts as (
  select host, n, bad, array_to_string(case when long then l[-3:] else l[-2:] end, '.') as domain,
         array_to_string(case when long then l[-2:] else l[-1:] end, '.') as suffix from cut),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by all),
s0 as (select suffix, sum(n) as n, sum(bad) as bad, (sum(sum(bad)) over () + 1.0) / (sum(sum(n)) over () + 2) as m
       from domains group by suffix),
s1 as (select suffix, ({_strength('s0')} * m + bad) / ({_strength('s0')} + n) as p from s0),
d0 as (select d.*, p as m from domains d join s1 using (suffix)),
d1 as (select domain, suffix, ({_strength('d0')} * m + bad) / ({_strength('d0')} + n) as p from d0),
h0 as (select h.*, p as m from hosts h join d1 using (domain, suffix)),
h1 as (select host, n, {_strength('h0')} as s, ({_strength('h0')} * m + bad) / ({_strength('h0')} + n) as p from h0),
ruled as (select *, cast(case {_RULED} end as int) as r from parts)
select page_id, host, path,
  case r {' '.join(f"when {i} then '{h + p}'" for i, (h, p, _) in enumerate(RULES))} end as rule,
  case {' '.join(f"when r = {i} then '{v}'" for i, (_, _, v) in enumerate(RULES))}
       when p - 1.645 * sqrt(p * (1 - p) / (s + n + 1)) >= 0.25 then 'block' else 'allow' end as verdict
from ruled join h1 using (host)""",
    "op8_line_dedup": f"""
with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from parts),
keyed as (select *, {_FOLD.format(f"trim(line, {_SPACE})")} as key from lines),
shared as (select key, max(doc_id) as keeper from keyed where length(key) >= 20
           group by key having count(distinct doc_id) >= 3),
marked as (select k.*, coalesce(doc_id < keeper, false) as gone from keyed k left join shared using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op13_source_divergence": r"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all({FOLD}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w, row_number() over () as d from documents),
each as (select lang, source, d, unnest(w) as term from docs),
kept as (select lang, term, count(*) as of_lang from each group by all having count(distinct d) >= 30),
sizes as (select lang, count(*) as v, sum(of_lang) as all_n from kept group by lang),
groups as (select distinct lang, source from docs),
here as (select lang, source, term, count(*) as n from each join kept using (lang, term) group by all),
totals as (select g.lang, g.source, v, all_n, coalesce(sum(n), 0) as total
           from groups g join sizes using (lang) left join here using (lang, source) group by all),
grid as (
  select t.lang, t.source, k.term, coalesce(n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v) as p,
         1 + (1000000000::hugeint * (of_lang + 5)) // (all_n + 5 * v) as q
  from totals t join kept k on t.lang = k.lang
  left join here h on h.lang = t.lang and h.source = t.source and h.term = k.term),
summed as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as f
           from grid x join grid y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(f, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
rows as (
  select lang, source, 'pair' as part, item, value from pairs
  union all
  select lang, source, 'term', term, (p - q)::bigint from grid where n > 0 and p > q)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
from rows qualify part = 'pair' or rank <= 50""".replace("{FOLD}", _FOLD.format("coalesce(text, '')")),
    "op9_warc": """
with rows as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
first as (select payload_digest, max(page_id) as page from rows where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page > page_id then 'revisit' else 'response' end as record_type,
       case when page > page_id then page end as refers_to
from rows left join first using (payload_digest)""",
}
