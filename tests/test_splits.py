"""Byte-range readers give the same rows at any split; the framed sink leaves whole files or none."""

import gzip
import random

import pyarrow as pa
import pytest

from exonloom.functions import registry
from exonloom.sources import framed, sequences, splits
from exonloom.sources import variants as gv


def genome_of(text):
    """Records of FASTA text by plain reading."""
    out, name = [], None
    for line in text.replace("\r", "").split("\n"):
        if line.startswith(">"):
            name = (line[1:].split() or [""])[0]
            out.append([name, ""])
        elif name is not None:
            out[-1][1] += line
    return [(n, s) for n, s in out if s]


def made(seed):
    rng = random.Random(seed)
    parts = [rng.choice(["", "ACGT\n"])]
    for i in range(rng.randint(1, 6)):
        parts.append(f">c{i}{rng.choice([' long description > of it' * 3, '', ' x'])}{rng.choice(['', chr(13)])}\n")
        bases = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 7, 90, 200])))
        width = rng.choice([10, 60, 1000])
        parts += [bases[k : k + width] + rng.choice(["\n", "\r\n"]) for k in range(0, len(bases), width)]
    text = "".join(parts)
    return text if rng.random() < 0.5 else text.rstrip("\n")


@pytest.mark.parametrize("seed", range(25))
def test_parts_of_any_two_ranges(tmp_path, seed):
    """Every cut of a file in two: headers are found once, and bases are those of the file."""
    text = made(seed)
    path = tmp_path / "a.fa"
    path.write_bytes(text.encode())
    want = [n for n, _ in genome_of(text + "\n")] 
    heads = [(line[1:].split() or [""])[0] for line in text.replace("\r", "").split("\n") if line.startswith(">")]
    for cut in range(1, len(text)):
        rows = [*splits.fasta_parts(str(path), 0, cut), *splits.fasta_parts(str(path), cut, len(text))]
        assert [r[2] for r in rows if r[0] == splits.HEADER] == heads
    assert set(want) <= set(heads)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_chunks_at_any_split(spark, tmp_path, split):
    texts = [made(s) for s in (31, 32)] + [">one\n" + "ACGT" * 100]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.fa").write_bytes(t.encode())
    (tmp_path / "_hidden").write_text(">no\nAAAA\n")
    got = splits.read_genome_ranges(spark, str(tmp_path), 16, split).collect()
    want = sorted((n, k // 16, s[k : k + 16], len(s)) for t in texts for n, s in genome_of(t) for k in range(0, len(s), 16))
    assert sorted(tuple(r) for r in got) == want


def test_a_chromosome_on_one_line_is_many_rows(spark, tmp_path):
    rng = random.Random(1)
    bases = "".join(rng.choice("ACGT") for _ in range(300_000))
    (tmp_path / "g.fa").write_text(f">chr1 x\n{bases}\n>chr2\nAC")
    got = splits.read_genome_ranges(spark, str(tmp_path / "g.fa"), 4096, 50_000)
    assert got.agg({"chrom_len": "max"}).first()[0] == 300_000
    same = sequences.read_genome(spark, str(tmp_path / "g.fa"), 4096)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in same.select("chrom", "chunk_no", "bases", "chrom_len").collect())


def blocks_of(text, sizes, rng):
    out, at = b"", 0
    while at < len(text):
        n = rng.choice(sizes)
        out += framed.compressed(text[at : at + n])
        at += n
    return out + framed.LAST_BLOCK


@pytest.mark.parametrize("seed", range(12))
def test_lines_of_any_two_ranges(tmp_path, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("ab\x1f\x8b\x08\x04é") for _ in range(rng.choice([0, 3, 40]))) for _ in range(12)]
    text = "\n".join(lines) + rng.choice(["", "\n"])
    data = blocks_of(text.encode(), [1, 5, 30], rng)
    path = tmp_path / "a.gz"
    path.write_bytes(data)
    assert gzip.decompress(data).decode() == text
    want = text.split("\n")[: -1 if text.endswith("\n") else None]
    for cut in range(1, len(data)):
        got = [*splits.block_lines(str(path), 0, cut), *splits.block_lines(str(path), cut, len(data))]
        assert [v for v, _ in got] == want
    for line, place in splits.block_lines(str(path), 0, len(data)):
        block, _ = splits.inflated(splits.Bytes(str(path)), place >> 16)
        assert line.encode().startswith(block[place & 0xFFFF :].split(b"\n")[0][: len(line.encode())])


def test_plain_gzip_is_refused(tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"x\n"))
    with pytest.raises(ValueError, match="not block-compressed"):
        list(splits.block_lines(str(tmp_path / "a.gz"), 0, 100))


def test_vcf_in_blocks_equals_its_plain_text(spark, tmp_path):
    header = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    vcf = spark.range(5000).selectExpr(
        "concat('chr', id % 3) as chrom", "id as pos", "concat('rs', id) as id", "'A' as ref", "'T' as alt", "'.' as qual", "'.' as filter", "concat('N=', id) as info", "'' as rest"
    ).repartition(3)
    framed.write_vcf(vcf, str(tmp_path / "z"), header)
    framed.write_vcf(vcf, str(tmp_path / "p"), header, blocks=False)
    files = sorted((tmp_path / "z").glob("*.vcf.gz"))
    assert len(files) == 3 and all(gzip.decompress(f.read_bytes()).decode().startswith("\n".join(header)) for f in files)
    lines = splits.read_block_lines(spark, str(tmp_path / "z"), 999)
    assert lines.rdd.getNumPartitions() > 20
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(gv.parse_vcf(lines)) == rows(gv.read_vcf(spark, str(tmp_path / "p"))) == rows(vcf.select(gv.parse_vcf(lines).columns))
    assert lines.filter("value like '#%'").count() == 6


def test_framed_files_are_replaced_as_a_whole(spark, tmp_path):
    out = tmp_path / "bed"
    beds = spark.range(10).selectExpr("'c' as chrom", "id as start", "id + 1 as end")
    framed.write_bed_track(beds.repartition(4), str(out), 'name="x"', bed6=False)
    framed.write_bed_track(beds.coalesce(1), str(out), 'name="y"', bed6=False)
    files = list(out.glob("part-*"))
    assert len(files) == 1 and files[0].read_text().split("\n")[:2] == ['track name="y"', "c\t0\t1"]
    bad = spark.range(10).selectExpr("case when id = 7 then raise_error('no') else 'x' end as value").repartition(2)
    with pytest.raises(Exception):  # noqa: B017
        framed.write_framed(bad, str(out), ["h"])
    assert [f.name for f in out.iterdir() if not f.name.startswith("_SUCCESS")] == [files[0].name]


def test_small_ranges_share_a_task(tmp_path):
    (tmp_path / "a.fa").write_bytes(b">x\n" + b"ACGT" * 5000 + b"\n>y\nGG\n")
    reader = splits.FastaReader({"path": str(tmp_path), "splitBytes": "100"})
    assert len(reader.ranges()) > 200 and len(reader.partitions()) == 1
    assert [r for task in reader.partitions() for r in task.ranges] == reader.ranges()


def test_nearest_before_by_batches():
    rows = [(1, 1, "t0"), (0, 3, "f0"), (1, 4, "t1"), (0, 5, "f1"), (1, 9, "t2"), (None, 10, "t3")]
    for cut in range(len(rows) + 1):
        function, got = registry.NearestBefore.func(), []
        for part in (rows[:cut], rows[cut:]):
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.string())], names=["kind", "pos", "name"])
            got += [tuple(r.values()) for t in function.eval(batch) for r in t.to_pylist()]
        assert got == [("t0", None, None), ("t1", "f0", 2), ("t2", "f1", 5), ("t3", "f1", 6)]
