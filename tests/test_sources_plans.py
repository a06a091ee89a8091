import random

import pytest
from pyspark.sql import functions as F

from exonloom.operators import annotation as an
from exonloom.operators import learn
from exonloom.operators import motifs as mo
from exonloom.operators import predict as pr
from exonloom.operators import tabular as tb
from exonloom.operators.ranking import rank_transcripts
from exonloom.plans import annotation_cache as ac
from exonloom.plans import paired
from exonloom.plans import perturbation as pp
from exonloom.sources import annotation as ga
from exonloom.sources import intervals as gi
from exonloom.sources import motifs as gm
from exonloom.sources import sequences as gs
from exonloom.sources import sinks
from exonloom.sources import tables as gt
from exonloom.sources import variants as gv
from exonloom.streaming import incremental


def write(path, text):
    path.write_text(text)
    return str(path)


def gtf_text():
    """Two transcripts of one gene with four exons each, coordinates 1-based."""
    lines = ["#comment"]
    row = lambda f, s, e, extra: f'chr1\tsrc\t{f}\t{s}\t{e}\t.\t+\t.\tgene_id "G1.2"; gene_name "GENE one"; {extra}'
    lines.append(row("gene", 101, 2000, 'gene_type "pc";'))
    for t, tag in (("T1.1", 'tag "basic"; tag "CCDS";'), ("T2.1", "")):
        lines.append(row("transcript", 101, 2000, f'transcript_id "{t}"; transcript_type "pc"; {tag}'))
        for n, (s, e) in enumerate([(101, 200), (501, 600), (901, 1000), (1901, 2000)], 1):
            lines.append(row("exon", s, e, f'transcript_id "{t}"; exon_number {n}; exon_id "E{n}.1";'))
    return "\n".join(lines) + "\n"


def test_gtf_and_cache(spark, tmp_path):
    path = write(tmp_path / "a.gtf", gtf_text())
    df = ac.prepare(ga.read_gtf(spark, path))
    tx = {r["transcript_id"]: r for r in df.filter("feature = 'transcript'").collect()}
    assert tx["T1"]["tag"] == "basic;CCDS" and tx["T2"]["tag"] is None and tx["T1"]["start"] == 100
    assert tx["T1"]["gene_id"] == "G1" and tx["T1"]["gene_name"] == "GENE"
    out = str(tmp_path / "cache")
    ac.build_cache(spark, path, out)
    level2 = ga.read_cache(spark, f"{out}/neighbours", "exon", 2)
    r = level2.filter("transcript_id = 'T1' and number = 2").first()
    assert (r["start_upstream_2"], r["end_upstream_2"], r["start_downstream_2"]) == (100, 200, 900)
    assert (r["feature_upstream_1"], r["distance_upstream_1"], r["length_upstream_1"]) == ("intron", 1, 300)
    assert not [c for c in ga.read_cache(spark, f"{out}/neighbours", "exon", 1).columns if c.endswith("_2")]
    targets = gi.intervals_from_strings(
        spark.createDataFrame([("chr1:501-600", "+", "GENE"), ("chr1:701-760", "+", "GENE"), ("chr1:601-660", "+", "GENE")], "target string, strand string, gene_name string"),
        "target", zero_based=False,
    )
    found, absent, discarded = ac.annotate(targets, level2, spark.read.parquet(f"{out}/features"))
    by_name = {r["name"]: r for r in found.collect()}
    assert by_name["chr1:501-600"]["transcript_id"] == "T1"
    novel = by_name["chr1:701-760"]
    assert novel["transcript_id"].startswith("T1_") and novel["number"] == 3 and novel["start_upstream_2"] == 500
    assert absent.count() == 2 and [r["name"] for r in discarded.collect()] == ["chr1:601-660"]
    kept, removed = ac.drop_overlapping(found)
    assert kept.count() == 2 and removed.count() == 0
    # straight from the annotation, with a gene and without one
    rows = lambda d: sorted(str(sorted(r.asDict().items())) for r in d.collect())
    for way in (targets, targets.drop("gene_name"), targets.drop("gene_name", "strand")):
        cached = ac.annotate(way, level2.drop("cache_feature"), spark.read.parquet(f"{out}/features"))
        direct = ac.annotate_direct(way, df)
        for a, b in zip(cached, direct):
            columns = sorted(set(a.columns) & set(b.columns))
            assert rows(a.select(columns)) == rows(b.select(columns))


def test_medians_fill_gaps(spark):
    rows = [(1.0, None, None), (None, 5.0, None), (2.0, float("nan"), None), (10.0, 7.0, None), (3.0, 6.0, None)]
    got = tb.impute_median(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()
    assert sorted(r["a"] for r in got) == [1.0, 2.0, 2.5, 3.0, 10.0] and sorted(r["b"] for r in got) == [5.0, 6.0, 6.0, 6.0, 7.0]
    assert all(r["c"] is None for r in got)


def test_ensembles_do_not_depend_on_padding(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (1, 3, 40, 41, 500, 7)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "seq_id string, seq string")
    results = []
    for options in ({"batch_size": 1}, {"batch_size": 4}, {"batch_bases": 50}, {}):
        scorer = pr.ensemble_scorer(pr.share_models, 10, "shares of the test")
        results.append(sorted((r["seq_id"], tuple(r["acceptor"]), tuple(r["donor"])) for r in pr.predict(df.repartition(2), scorer, **options).collect()))
    assert all(r == results[0] for r in results)
    for i, acceptor, donor in results[0]:
        t = texts[int(i)]
        for p in range(len(t)):
            left, right = t[max(p - 9, 0) : p + 1], t[p : p + 10]
            assert acceptor[p] == pytest.approx(sum(x in "CG" for x in left) / 20 + sum(x in "AG" for x in left) / 20)
            assert donor[p] == pytest.approx(sum(x in "CG" for x in right) / 20 + sum(x in "AG" for x in right) / 20)


def test_rank_is_deterministic(spark):
    df = spark.createDataFrame(
        [("g", "b", 0, 10, "basic"), ("g", "a", 0, 10, "basic"), ("g", "c", 0, 90, None), ("h", "d", 0, 5, None), ("h", "e", 0, 6, None)],
        "gene_id string, transcript_id string, start long, end long, tag string",
    )
    top = {r["gene_id"]: (r["transcript_id"], r["rank_score"]) for r in rank_transcripts(df, True).collect()}
    assert top == {"g": ("a", 5), "h": ("e", -1)}


def test_interval_files(spark, tmp_path):
    bed = write(tmp_path / "a.bed", "chr1\t5\t10\tn\t0\t+\n")
    assert gi.bed_is_valid(spark, bed) and gi.read_bed(spark, bed).first()["end"] == 10
    bad = write(tmp_path / "b.bed", "chr1\tx\t10\n")
    assert not gi.bed_is_valid(spark, bad)
    with pytest.raises(ValueError):
        gi.bed_is_valid(spark, bad, raise_error=True)
    tsv = write(tmp_path / "t.tsv", "chr1:5-9\t1\t+\textra\nchr2:7-8\t2\t-\tmore\n")
    r = gi.read_interval_strings(spark, tsv, zero_based=False).orderBy("chrom").first()
    assert (r["start"], r["end"], r["name"], r["strand"], r["col_3"]) == (4, 9, "chr1:5-9", "+", "extra")
    with pytest.raises(Exception, match="strand must be"):
        gi.intervals_from_strings(spark.createDataFrame([("c:1-2", "?")], "t string, strand string"), "t").collect()
    out = str(tmp_path / "o")
    sinks.write_bed(gi.read_bed(spark, bed), out)
    assert spark.read.text(out).first()[0] == "chr1\t5\t10\tn\t0\t+"
    with pytest.raises(ValueError):
        sinks.write_bedgraph(gi.read_bed(spark, bed), str(tmp_path / "x.txt"), "score")


def test_fasta_round_trip(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">c1 some text\nACGT\nAC\n>chr2:5-9(-)_t\nGG\n")
    df = gs.read_fasta(spark, path)
    assert {tuple(r) for r in df.collect()} == {("c1", "ACGTAC"), ("chr2:5-9(-)_t", "GG")}
    parsed = {r["seq_id"]: (r["chrom"], r["start"], r["strand"]) for r in gi.header_intervals(df).collect()}
    assert parsed == {"c1": (None, None, None), "chr2:5-9(-)_t": ("chr2", 5, "-")}
    out = str(tmp_path / "fa")
    sinks.write_fasta(df, out, files=2)
    assert {tuple(r) for r in gs.read_fasta(spark, out).collect()} == {tuple(r) for r in df.collect()}


def test_motif_files(spark, tmp_path):
    path = write(tmp_path / "m.txt", ">RA|2|\n*UGUAU|ACGTAC|AC\n\n>RB|1|\n*GGGGG\nMOUSE\n>RC|1|\n*TTTTT\n")
    got = {tuple(r) for r in gm.read_motif_list(spark, path).collect()}
    assert got == {("RA", "TGTAT"), ("RA", "ACGTAC"), ("RB", "GGGGG")}
    assert ("RA", "UGUAU") in {tuple(r) for r in gm.read_motif_list(spark, path, rna_to_dna=False).collect()}
    twice = write(tmp_path / "d.txt", ">RA|1|\n*AAAAA\n>RA|1|\n*CCCCC\n")
    with pytest.raises(Exception, match="repeated RBP"):
        gm.read_motif_list(spark, twice).collect()
    meme = write(tmp_path / "p.meme", "MEME version 4\n\nMOTIF M1 RX\n\nletter-probability matrix: alength= 4 w= 2\n0.7 0.1 0.1 0.1\n0 1 0 0\n\nMOTIF M2 RY\nletter-probability matrix:\n0.25 0.25 0.25 0.25")
    rows = gm.read_meme(spark, meme).collect()
    assert len(rows) == 12 and {(r["motif_id"], r["rbp_name"]) for r in rows} == {("M1", "RX"), ("M2", "RY")}
    again = str(tmp_path / "again")
    gm.meme_records(gm.read_meme(spark, meme)).select("value").coalesce(1).write.text(again)
    assert gm.read_meme(spark, again).count() == 12
    (tmp_path / "pwm").mkdir()
    write(tmp_path / "pwm" / "001.PWM", "PO\tA\tC\tG\tU\n1\t1\t0\t0\t0\n2\t0\t0\t1\t0\n")
    ids = gm.motif_ids_from_labels(spark.createDataFrame([("1", "NAME (1), OTHER (2)")], "id string, label string"), "id", "label")
    db = gm.matrix_database(gm.read_matrix_files(spark, str(tmp_path / "pwm")), ids)
    assert {r["rbp_name"] for r in db.collect()} == {"NAME", "OTHER"} and db.count() == 16
    table = spark.createDataFrame([("RA", "AAAAA"), ("RB", "CCCCC")], "rbp_name string, motif string")
    assert gm.resolve_subset(table, ["RA", "RZ"]).count() == 1
    assert [r[0] for r in gm.missing_names(table, ["RA", "RZ"]).collect()] == ["RZ"]
    assert gm.resolve_subset(table, "few", {"few": ["RB"]}).first()["rbp_name"] == "RB"
    with pytest.raises(KeyError):
        gm.resolve_subset(table, "unknown", {})
    with pytest.raises(ValueError):
        gm.resolve_subset(table, ["RZ"])


VCF = """##fileformat=VCFv4.2
##contig=<ID=1,length=5>
##contig=<ID=MT>
##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence. Format: Allele|STRAND|Gene|SYMBOL|Feature|HGVSc|EXON|INTRON|VARIANT_CLASS">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO
1\t10\ta\tACG\tA\t.\t.\tCSQ=-|-1|g1|S|t1|h|1/2||deletion,x|1|y|z|w|||
MT\t20\tb\tA\tATT\t.\t.\tCSQ=-|1|g2|S|t2|h|1/2||insertion
"""


def test_variants(spark, tmp_path):
    path = write(tmp_path / "v.vcf", VCF)
    header = gv.read_header(spark, path)
    key, fields = gv.consequence_format(header)
    assert key == "CSQ" and fields[-1] == "VARIANT_CLASS"
    vcf = gv.read_vcf(spark, path)
    got = {r["id"]: r for r in gv.variant_intervals(vcf, fields, key).collect()}
    assert (got["a"]["start"], got["a"]["end"], got["a"]["strand"], got["a"]["gene_id"], got["a"]["variant_class"]) == (9, 12, "-", "g1", "deletion")
    assert (got["b"]["start"], got["b"]["end"], got["b"]["strand"]) == (19, 22, "+")
    assert gv.needs_prefix(vcf) is True and gv.needs_prefix(vcf, ["1", "MT"]) is None and gv.needs_prefix(vcf, ["chr1"]) is True
    assert {r["chrom"] for r in gv.fix_chromosome_names(vcf).collect()} == {"chr1", "chrM"}
    assert {r["chrom"] for r in gv.fix_chromosome_names(gv.fix_chromosome_names(vcf), add=False).collect()} == {"1", "M"}
    assert gv.fix_contig_lines(header)[1:3] == ["##contig=<ID=chr1,length=5>", "##contig=<ID=chrM>"]
    value = spark.createDataFrame([("1", 10, "ACG", "A", "0.5")], "chrom string, pos long, ref string, alt string, v string")
    lines = {r["id"]: r["info"] for r in gv.annotate_variants(vcf, value, "v").collect()}
    assert lines["a"].endswith(";v=0.5") and lines["b"].endswith(";v=.")
    with pytest.raises(Exception, match="more than one value"):
        gv.annotate_variants(vcf, value.union(value), "v").collect()
    with pytest.raises(ValueError):
        gv.annotate_variants(vcf, value, "v", existing=["v"])
    assert gv.vcf_lines(vcf).count() == 2
    multi = vcf.withColumn("alt", F.lit("A,T"))
    with pytest.raises(Exception, match="multi-allelic"):
        gv.variant_intervals(multi).collect()


def test_site_index_matching(spark):
    index = gt.site_columns(spark.createDataFrame(
        [("c:1-9(+)", "t", "<NA>;3;<NA>", "<NA>;5;<NA>")], "header string, tx_id string, acceptor_idx string, donor_idx string"))
    seqs = spark.createDataFrame([("c:1-9(+)_t_REF_seq",)], "seq_id string")
    r = gt.match_site_index(seqs, index).first()
    assert (r["seq_id"], r["start_exon_cassette"], r["end_exon_cassette"], r["start_exon_upstream"]) == ("c:1-9(+)_t", 3, 5, None)
    with pytest.raises(Exception, match="several index rows"):
        gt.match_site_index(seqs, index.union(index)).collect()


def test_biotypes_are_checked(spark):
    df = spark.createDataFrame([("a",), ("b",)], "kind string")
    assert an.filter_biotypes(df, "kind", ["a"]).count() == 1
    with pytest.raises(ValueError):
        an.filter_biotypes(df, "kind", ["a", "z"])


def test_dense_classes(spark):
    exons = spark.createDataFrame([("t", "+", 10, 13), ("t", "+", 20, 24)], "transcript_id string, strand string, start long, end long")
    tx = spark.createDataFrame([("t", 10, 24)], "transcript_id string, start long, end long")
    classes = an.dense_classes(an.base_class_marks(exons), tx).first()["classes"]
    assert classes == [0, 0, 0, 1, 1, 0, 0, 0, 2, 2, 0, 0, 0, 0]


def test_whole_run(spark, tmp_path):
    """Annotation to effects on a made genome; deletions shorten and effects align."""
    rng = random.Random(4)
    bases = "".join(rng.choice("ACGT") for _ in range(3000))
    genome = gs.chunk_sequences(spark.createDataFrame([("chr1", bases)], "seq_id string, seq string"), 256)
    path = write(tmp_path / "a.gtf", gtf_text())
    features = ac.features_of(ac.prepare(ga.read_gtf(spark, path)), genome, 256)
    gc = features.filter("transcript_id = 'T1' and feature = 'exon' and number = 1").first()["gc"]
    part = bases[100:200]
    assert gc == pytest.approx(100 * (part.count("G") + part.count("C")) / 100)
    around = an.neighbours(features.filter("transcript_id = 'T1'"), 2, "exon", ["gc", "length"])
    table = spark.createDataFrame([("RA", bases[520:526]), ("RB", bases[520:525]), ("RB", "TTTTT"), ("RC", "ACGT")], "rbp_name string, motif string")
    options = pp.Options(reach=400, scope=300, chunk=256)
    summary = pp.run(spark, around, genome, table, str(tmp_path / "run"), pr.consensus_scorer, options)
    rows = summary.collect()
    seqs = {r["seq_id"]: r for r in spark.read.parquet(str(tmp_path / "run/sequences")).collect()}
    hits = spark.read.parquet(str(tmp_path / "run/hits"))
    assert rows and {r["seq_id"] for r in rows} <= set(seqs)
    assert all(s["seq"] == bases[s["win_start"]:s["win_end"]] for s in seqs.values())
    assert {(r["rbp_name"], r["motif_start"]) for r in rows} == {(r["rbp_name"], r["start"]) for r in hits.collect()}
    assert all(r["location"] is not None for r in rows)
    edge = spark.read.parquet(str(tmp_path / "run/first_or_last"))
    assert edge.count() == 2
    full, _ = pp.windows(around, genome, pp.Options(full_windows=True, border=50, chunk=256))
    for s in full.collect():
        assert s["seq"] == bases[s["win_start"]:s["win_end"]]
        assert s["win_start"] + s["start_exon_cassette"] in (500, 900)


def test_paired_plan(spark):
    events = spark.createDataFrame(
        [("c:1-9", "g", "G", "KD1", 0.3, 1), ("c:1-9", "g", "G", "KD1", -0.5, 2), ("c:20-29", "g", "G", "KD1", 0.05, 3)],
        "target_coordinates string, gene_name string, gene_id string, group string, dPSI double, id int")
    controls = spark.createDataFrame(
        [("c:40-49", "g", "G", "KD1", 0.02, 4), ("c:40-49", "g", "G", "KD1", -0.01, 5), ("c:1-9", "g", "G", "KD1", 0.0, 6), ("c:60-69", "g", "G", "KD1", 0.2, 7)],
        events.schema)
    kd, ctrl = paired.select_events(events, controls)
    assert [r["id"] for r in kd.collect()] == [2] and [r["id"] for r in ctrl.collect()] == [5]
    rng = random.Random(2)
    rows = [("R", "KD" if i < 10 else "CTRL", i, f"c:{i}", *[rng.uniform(20, 80) for _ in range(3)], *[float(rng.randrange(50, 5000)) for _ in range(3)]) for i in range(40)]
    exons = spark.createDataFrame(rows, "rbp_name string, exon_group string, ord long, target_coordinates string, " + ", ".join(f"{c} double" for c in paired.FEATURES + paired.LENGTHS))
    for name in ("euclidean", "max_l"):
        pairs = paired.pair(exons, "ord", name).collect()
        assert len(pairs) == 10 and len({r["ctrl_order"] for r in pairs}) == 10


def test_learning(spark):
    rng = random.Random(1)
    rows = [(i, float(i % 2), float(i % 2) + rng.gauss(0, 0.1), rng.gauss(0, 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double")
    scores = learn.cross_validate(df, "tree", ["a", "b"], "y", "id", folds=2)
    assert min(scores) > 0.9
    model = learn.pipeline("tree", ["a", "b"], "y").fit(df)
    weight = learn.importances(model, ["a", "b"])
    assert weight["a"] > weight["b"]
    assert learn.closest_to_chance({"x": [0.9, 0.8], "y": [0.5, 0.55]}) == "y"
    real, p = learn.permutation_p_value(df, "tree", ["a", "b"], "y", "id", rounds=1, folds=2)
    assert real > 0.9 and p == 0.5


def test_incremental_scan(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    one = spark.createDataFrame([("a", "AAAAAACGT")], "seq_id string, seq string")
    one.write.parquet(folder)
    stream = incremental.read_sequences(spark, folder)
    incremental.append_metadata(stream, {"AAA": ["R"]}, out, check).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    one.withColumn("seq_id", F.lit("b")).write.mode("append").parquet(folder)
    incremental.append_metadata(incremental.read_sequences(spark, folder), {"AAA": ["R"]}, out, check).awaitTermination(60)
    assert {r["id"] for r in spark.read.parquet(out).collect()} == {"a_DEL_0_3", "a_DEL_3_6", "b_DEL_0_3", "b_DEL_3_6"}


def test_run_statistics_and_tsv(spark, tmp_path):
    df = spark.createDataFrame([("x", [1, 2]), ("y", None)], "name string, v array<int>")
    stats = {r["statistic"]: r["value"] for r in sinks.run_statistics(df, df.filter("name = 'x'"), df, df, df.limit(0)).collect()}
    assert stats["n_events"] == 2 and stats["n_unknown"] == 1 and stats["n_discarded"] == 0
    out = str(tmp_path / "t")
    sinks.write_tsv(df, out)
    back = {r["name"]: r["v"] for r in gt.read_tsv_union(spark, [out]).collect()}
    assert back["x"] == "1;2"
    sinks.write_ids(df, str(tmp_path / "ids"), "name")
    assert ga.read_ids(spark, str(tmp_path / "ids")).count() == 2


def test_duplicate_attributes(spark):
    df = spark.createDataFrame([("s", "B", "m", 1, 4), ("s", "A", "n", 1, 4)], "seq_id string, rbp_name string, motif string, start long, end long")
    assert mo.merge_duplicate_hits(df, ["rbp_name", "motif"]).first()["motif"] == "n;m"


def test_attribute_texts_are_taken_apart_once(spark):
    text = 'gene_id "g1.2"; tag "a"; tag "b c";note x ; level 2;\tempty; gene_name "n"'
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "gene_id")], "k int, attribute string")
    made = ga.expand_attributes(df.filter("k > 0"))
    got = {r["k"]: r for r in made.collect()}
    assert (got[1]["gene_id"], got[1]["tag"], got[1]["level"], got[1]["gene_name"]) == ("g1.2", "a;b", "2", "n")
    assert all(v is None for k in (2, 3, 4) for c, v in got[k].asDict().items() if c != "k")
    one = df.select("k", ga.attribute_value(F.col("attribute"), "tag").alias("tag"))
    assert {r["k"]: r["tag"] for r in one.collect()} == {k: r["tag"] for k, r in got.items()}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_taken_apart_once_and_rows_shuffled_once(spark, tmp_path):
    lines = [x for x in gtf_text().splitlines()] + ['chr1\tsrc\texon\t5\t9\t.\t+\t.\ttranscript_id "T1.1";']  # an exon of no gene
    annotation = ac.prepare(ga.parse_gtf(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert "SortMergeJoin" not in _plan(annotation)  # genes with two rows are stored, their size is known
    targets = spark.createDataFrame(
        [("a", "chr1", 500, 600, "+", "G1"), ("b", "chr1", 700, 760, "+", "G1"), ("c", "chr1", 4, 9, "+", None), (None, "chr1", 900, 1000, "+", "G1")],
        "name string, chrom string, start bigint, end bigint, strand string, gene_id string",
    )
    found, absent, _ = ac.annotate_direct(targets, annotation)
    assert "regexp" not in _plan(found) and "regexp" not in _plan(absent)
    got = {r["name"]: (r["transcript_id"].partition("_")[0], r["number"], r["start_upstream_2"]) for r in found.collect()}
    assert got == {"a": ("T1", 2, 100), "b": ("T1", 3, 500), None: ("T1", 3, 500)}
    assert sorted(r["name"] for r in absent.collect()) == ["b", "c"]
    body = annotation.filter("feature = 'exon'").select("transcript_id", "chrom", "strand", "start", "end")
    numbered = an.neighbours(an.subfeatures(body))
    assert _plan(numbered).count("Exchange hashpartitioning") == 1


def test_best_match_leaves_unused_columns_behind(spark):
    rows = [("k", 1, "b", "x1"), ("k", 3, "c", "x2"), ("k", 3, "a", "x3"), (None, -1, "z", "x4"), ("n", None, "q", "x5"), ("n", 2, "r", "x6")]
    df = spark.createDataFrame(rows, "k string, rank_score bigint, t string, wide string")
    best = an.top_known(df, ["k"], ["t"])
    assert best.columns == df.columns
    # a score that is not known stands first, as in the order of a struct
    assert sorted(map(tuple, best.collect()), key=str) == sorted([("k", 3, "a", "x3"), (None, -1, "z", "x4"), ("n", None, "q", "x5")], key=str)
    assert "wide" not in _plan(best.select("k", "t")).split("Exchange")[0]  # what is above the shuffle


def test_cache_is_written_from_one_window(spark, tmp_path, monkeypatch):
    calls, real = [], an.neighbours
    monkeypatch.setattr(an, "neighbours", lambda *a, **k: calls.append(1) or real(*a, **k))
    path, out = write(tmp_path / "a.gtf", gtf_text()), str(tmp_path / "cache")
    ac.build_cache(spark, path, out)
    assert len(calls) == 1  # the features are not shuffled once for exons and once for introns
    rows = lambda d: sorted(str(sorted(r.asDict().items())) for r in d.collect())
    features = ac.features_of(ac.prepare(ga.read_gtf(spark, path)))
    stored = spark.read.parquet(f"{out}/features")
    assert stored.columns == features.columns and rows(stored) == rows(features) and stored.count() == 2 * (4 + 3)
    for kind in ("exon", "intron"):
        assert rows(ga.read_cache(spark, f"{out}/neighbours", kind, 2).drop("cache_feature")) == rows(real(features, 2, kind, ["length"]))
    # an annotation without transcripts has a cache without rows
    ac.build_cache(spark, write(tmp_path / "b.gtf", "#comment\n"), f"{out}2")
    assert spark.read.parquet(f"{out}2/features").count() == 0
