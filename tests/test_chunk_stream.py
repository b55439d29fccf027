"""Chunks of documents that come in many batches."""

import random
import resource
from itertools import count

import pyarrow as pa
from lexquarry.operators import chunking
from lexquarry.operators.chunking import Packing
from lexquarry.operators.structure import location
from pyspark.sql import functions as F


def whole(elements, limit):
    """A document's chunks in one go: (seq that locates it, suffix, text)."""
    pack, out = Packing(limit), []
    for kind, text, seq in elements:
        out += pack.add(kind, text, seq)
    return [*out, *pack.end()]


def test_batches_do_not_matter(spark):
    rng = random.Random(4)
    docs = {d: [(rng.choice(["paragraph"] * 6 + ["article", "table_row", "heading"]), "字" * rng.choice([0, 1, 5, 20, 60]) + "。", i) for i in range(rng.randint(0, 60))] for d in range(30)}
    rows = [(d, seq, kind, text) for d, own in docs.items() for kind, text, seq in own]
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "doc_id long, seq int, kind string, text string").withColumn("location", location(paragraph_seq=F.col("seq")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {}
            for r in chunking.chunks_of(e, limit=50).collect():
                got.setdefault(r.doc_id, []).append((r.chunk_no, r.location.paragraph_seq, r.suffix, r.text))
            for d, own in docs.items():
                assert sorted(got.get(d, [])) == [(n, *x) for n, x in enumerate(whole(own, 50))], (size, d)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_document_of_a_million_lines_in_bounded_memory():
    """Batches are made as they are asked for: what the fold holds doesn't grow with the document."""
    place = pa.array([{"paragraph_seq": 1}] * 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 1000), pa.array(["paragraph"] * 1000), pa.array(["一行文字，" * 8] * 1000), place], ["doc_id", "kind", "text", "location"])
    step = count()
    run = chunking._folded("doc_id", 400)(batch for _ in range(1000) if next(step) >= 0)
    for _ in range(20):
        next(run)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = last = 0
    for out in run:
        n += out.num_rows
        last = max([last, *out.column("chunk_no").to_pylist()])
    assert n > 95_000 and last > 99_000 and next(step) == 1000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10  # KB
