"""Sources and targets that are reached page by page through a function of the caller's: no network code of its own.

A source's fetch(offset, limit) returns a page, in one of the shapes below; a page is parsed into records and written
to Parquet before the next one is asked for, so the driver never holds more than one. A target's send(records) gets
batches on the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from sagitta.functions.records import ID_NAMES, VECTOR_NAMES

SCHEMA = "id string, vector array<float>, metadata string"
Record = tuple[str, list[float], str | None]


def _record(fields: dict, metadata: dict | None) -> Record:
    id_ = next((fields[n] for n in ID_NAMES if fields.get(n) is not None), "unknown")
    vector = next((fields[n] for n in VECTOR_NAMES if isinstance(fields.get(n), list)), [])
    return str(id_), [float(x) for x in vector], json.dumps(metadata) if metadata else None


def scroll_page(page: dict) -> tuple[list[Record], object]:
    """{"result": {"points": [{id, vector, payload}], "next_page_offset"}}: the records and the next offset, of any type."""
    result = page.get("result", {})
    rows = [(p | {"vector": p["vector"].get("default", [])} if isinstance(p.get("vector"), dict) else p) for p in result.get("points", [])]
    return [_record(p, p.get("payload")) for p in rows], result.get("next_page_offset")


def entity_page(page: dict) -> tuple[list[Record], object]:
    """{"data": [{id, vector or embedding, other fields}]}: the next offset is counted by the caller."""
    out = [_record(e, {k: v for k, v in e.items() if k not in (*ID_NAMES, *VECTOR_NAMES)}) for e in page.get("data", [])]
    return out, None


def graph_page(page: dict) -> tuple[list[Record], object]:
    """{"data": {"Get": {Class: [{fields, _additional: {id, vector}}]}}}."""
    out = []
    for objects in page.get("data", {}).get("Get", {}).values():
        for o in objects:
            out.append(_record(o.get("_additional", {}), {k: v for k, v in o.items() if k != "_additional"}))
    return out, None


def match_page(page: dict) -> tuple[list[Record], object]:
    """{"matches": [{id, values, metadata}], "pagination": {"next"}}."""
    out = [_record({"id": m.get("id"), "vector": m.get("values", [])}, m.get("metadata")) for m in page.get("matches", page.get("vectors", []))]
    return out, page.get("pagination", {}).get("next")


PAGES = {"scroll": scroll_page, "entities": entity_page, "graph": graph_page, "matches": match_page}


def pages(fetch: Callable[[object, int], dict], shape: str, limit: int = 1000) -> Iterator[list[Record]]:
    """Pages until one names no next offset (or, where offsets are counted, until one is short)."""
    offset: object = None if shape in ("scroll", "matches") else 0
    while True:
        found, following = PAGES[shape](fetch(offset, limit))
        if found:
            yield found
        if shape in ("scroll", "matches"):
            if following is None:
                return
            offset = following
        elif len(found) < limit:
            return
        else:
            offset += limit


def imported(spark: SparkSession, fetch: Callable[[object, int], dict], shape: str, path: str, limit: int = 1000) -> DataFrame:
    """All records of a source, as the Parquet table at path."""
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)
    for found in pages(fetch, shape, limit):
        spark.createDataFrame(found, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def exported(rows: DataFrame, send: Callable[[list[dict]], None], batch: int = 100) -> None:
    """Sends all records in batches from the executors; a repeated task sends its batches again, so send must be an upsert."""

    def work(part: Iterator) -> None:
        held: list[dict] = []
        for r in part:
            held.append({"id": r.id, "vector": list(r.vector), "payload": json.loads(r.metadata) if r.metadata else {}})
            if len(held) == batch:
                send(held)
                held = []
        if held:
            send(held)

    rows.select("id", "vector", "metadata").foreachPartition(work)


def read_hdf5(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """Records of an HDF5 file with datasets vectors and, if there are, ids and metadata; needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("HDF5 files need h5py") from e
    with h5py.File(path, "r") as f:
        n = len(f["vectors"])
    parts = spark.createDataFrame([(a, min(n, a + chunk)) for a in range(0, n, chunk)], "a long, b long")

    def work(frames):
        import h5py
        import pandas as pd

        with h5py.File(path, "r") as f:
            for frame in frames:
                for a, b in frame.itertuples(index=False):
                    text = lambda name, default: [x.decode() if isinstance(x, bytes) else str(x) for x in f[name][a:b]] if name in f else default  # noqa: B023, E731
                    yield pd.DataFrame({"id": text("ids", [f"vec_{i}" for i in range(a, b)]), "vector": [list(map(float, v)) for v in f["vectors"][a:b]], "metadata": text("metadata", [None] * (b - a))})

    return parts.mapInPandas(work, SCHEMA)
