"""Files to symbols, imports, calls and inheritance: one pass over the texts, then plain tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.extraction import Parsed, parse

SYMBOL = "struct<id:string,name:string,qualified_name:string,kind:string,file_path:string,line_start:int,line_end:int,docstring:string,parameters:array<string>,param_types:map<string,string>,is_exported:boolean,is_entrypoint:boolean,complexity:int>"
IMPORT = "struct<source_module:string,imported_name:string,alias:string,line_number:int,is_wildcard:boolean>"
CALL = "struct<caller_id:string,callee_name:string,line_number:int>"
INHERIT = "struct<child_id:string,parent_name:string,relation:string>"
PARTS = {"symbols": SYMBOL, "imports": IMPORT, "calls": CALL, "inheritance": INHERIT}
#: What linking needs of a file.
LINKED = PARTS | {"symbols": "struct<id:string,name:string,qualified_name:string,kind:string,param_types:map<string,string>>", "contained": "struct<src:string,dst:string>"}
#: Fixed value: files that are held as Python objects at once.
FILES = 500


def contained(path: str, p: Parsed) -> list[dict]:
    """As link.contains of one file, but for those in nothing that is known: classes to their methods, its module to what is at its top."""
    known = {s["id"] for s in p.symbols}
    module = next((s["id"] for s in p.symbols if s["kind"] == "module"), None)
    pairs = []
    for s in {s["id"]: s for s in p.symbols if s["kind"] != "module"}.values():
        scope, dot, _ = s["qualified_name"].rpartition(".")
        if bool(dot) == (s["kind"] == "method"):
            parent = f"{path}::{scope}" if dot else None
            src = parent if parent in known else module
            if src is not None:
                pairs.append({"src": src, "dst": s["id"]})
    return pairs


def _batches(files: DataFrame, kinds: dict[str, str], linked: bool) -> DataFrame:
    clean = files.select("repo_id", F.regexp_replace("file_path", r"^(\./)+", "").alias("file_path"), "content")
    kind = StructType.fromDDL(", ".join(["repo_id int", "file_path string", *(f"{p} array<{k}>" for p, k in kinds.items())]))
    schema = to_arrow_schema(kind)
    with_symbols, wanted = "symbols" in kinds, [k for k in kinds if k != "contained"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                rows = []
                for x in batch.slice(at, FILES).to_pylist():
                    p = parse(x["file_path"] or "", x["content"] or "")
                    if p:
                        row = {"repo_id": x["repo_id"], "file_path": x["file_path"]} | {k: getattr(p, k) for k in wanted}
                        if linked:
                            known = {s["id"] for s in p.symbols}
                            row["contained"] = contained(x["file_path"], p)
                            row["calls"] = [c for c in p.calls if c["caller_id"] in known]
                            row["inheritance"] = [c for c in p.inheritance if c["child_id"] in known]
                        for s in p.symbols if with_symbols else ():
                            s["param_types"] = list(s["param_types"].items())  # as Arrow takes maps
                        rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return clean.mapInArrow(parsed, kind)


def extract(files: DataFrame, parts: Sequence[str] = tuple(PARTS)) -> DataFrame:
    """One row a file of a known language, with an array a part; a file that does not parse keeps its module symbol."""
    return _batches(files, {p: PARTS[p] for p in parts}, False)


def linked(files: DataFrame) -> DataFrame:
    """As extract, with what linking needs only: containment within the file, and no calls or children of unknown symbols, since they give no edge."""
    return _batches(files, LINKED, True)


def tables(extracted: DataFrame) -> dict[str, DataFrame]:
    """The parts of what was extracted, with the numbers that the linking operators need: by path, then place."""
    out = {}
    for name, seq in (("symbols", "symbol_seq"), ("imports", "import_id"), ("calls", "call_id"), ("inheritance", "inherit_id"), ("contained", "contained_id")):
        if name not in extracted.columns:
            continue
        rows = extracted.select("repo_id", F.col("file_path").alias("_path"), F.posexplode(name).alias("_pos", "x"))
        # the rank of a file's path is replaced by its hash: order within a file is what linking needs to be exact
        number = (F.shiftleft(F.xxhash64("repo_id", "_path").bitwiseAND(F.lit(2**42 - 1)), 20) + F.col("_pos")).cast("bigint")
        rows = rows.select("repo_id", number.alias(seq), "_path", "x.*")
        out[name] = rows.drop("_path") if "file_path" in rows.columns else rows.withColumnRenamed("_path", "file_path")
    return out
