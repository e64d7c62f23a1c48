"""Drifting JSON layouts: tagged-union schemas per file, the changes between files, and one table of standard records."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, small_side, staged

#: A file has a field that at least this share of its records carries.
FIELD_SHARE = 0.1
#: Two fields have the same content if their values' shapes agree in at least this share.
SAME_CONTENT = 0.5

#: The fields of a standard focus, and what the document's type is called in the source data.
STANDARD = ["ticker", "year", "quarter", "raw_quarter", "normalized_doc_type", "source_id", "exchange", "date", "time", "company_name"]
SAME_FIELD = {"doc_type": "normalized_doc_type", "source_type": "normalized_doc_type", "filing_type": "normalized_doc_type"}


def json_type(value: object) -> str:
    """The JSON type name; ``null`` for null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def record(line: str | None) -> dict | None:
    """The JSON object in a line, or None for blank, broken and other lines."""
    if not line or "{" not in line:
        return None
    try:
        got = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def focus_parts(rec: dict) -> tuple[dict, list[dict]]:
    """(the metadata object or {}, the focus objects): focuses stand in a list or alone, in the metadata, at the top, or are it."""
    meta = next((v for k, v in rec.items() if isinstance(v, dict) and k != "focuses"), {})
    for owner in (meta, rec):
        for key, value in owner.items():
            if isinstance(value, list) and any(isinstance(x, dict) for x in value):
                return meta, [x for x in value if isinstance(x, dict)]
            if isinstance(value, dict) and value is not meta and (key == "focuses" or len(value) > 2):
                return meta, [value]
    return meta, []


def fields_of(rec: dict) -> Iterator[tuple[str, object]]:
    """(name, value) of every field: keys of the record, of its metadata object, and of its focus objects."""
    meta, focuses = focus_parts(rec)
    yield from rec.items()
    yield from meta.items()
    for f in focuses:
        yield from f.items()


def shape(value: object) -> str:
    """What a value looks like: runs of digits and capitals by length, other letters as one; wrappers of one value are opened."""
    while isinstance(value, list) and len(value) == 1 and not isinstance(value[0], dict) or isinstance(value, dict) and len(value) == 1 and not isinstance(next(iter(value.values())), list | dict):
        value = value[0] if isinstance(value, list) else next(iter(value.values()))
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "objects" if any(isinstance(x, dict) for x in value) else "array"
    if isinstance(value, bool) or value in ("true", "false"):
        return "boolean"
    text = str(value)
    if len(text) > 60:
        return f"text {len(text).bit_length()}"
    if re.fullmatch(r"-?\d+\.\d+(e-?\d+)?", text):
        return "decimal"
    text = re.sub(r"\d+", lambda m: f"9{min(len(m[0]), 9)}", text)
    text = re.sub(r"[A-Z]+", lambda m: f"A{min(len(m[0]), 9)}", text)
    return re.sub(r"[^\W\d_A]+", "a", re.sub(r"(?<=A\d)[a-z]+", "a", text))


def _deduplicated(lines: DataFrame) -> DataFrame:
    """One row per line of a file; a line delivered twice counts once (of different contents, the least).

    Only the keys of all lines are shuffled; the lines themselves only where there are several of a key.
    """
    keys = ["stream_name", "file_name", "line_no"]
    rows = lines.where("file_name is not null").select(*keys, "written_at", "raw_line")
    again = small_side(staged(rows.groupBy(*keys).count().where("count > 1").select(*(F.col(c).alias(f"_{c}") for c in keys)), "again"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys))
    several = rows.join(again, same, "left_semi").groupBy(*keys).agg(F.min("written_at").alias("written_at"), F.min("raw_line").alias("raw_line"))
    return rows.join(again, same, "left_anti").unionByName(several)


def file_schemas(lines: DataFrame) -> DataFrame:
    """(stream_name, file_name, written_at, n_records, field, type, n_type, n_carry, shapes): the tagged union of each file.

    One row per field and alternative type, null included; ``n_carry`` counts the records with the field, ``n_type`` the values
    of this type, ``shapes`` maps the shapes of its values to counts. Lines that are no JSON object count nothing. A file whose
    lines hold no record has no row. Each task adds up its own lines, so a large file is no single task's work.
    """

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            files: Counter = Counter()
            carry: Counter = Counter()
            shapes: Counter = Counter()
            for stream, name, at, line in zip(b.stream_name, b.file_name, b.written_at, b.raw_line, strict=True):
                rec = record(line)
                if rec is None:
                    continue
                file = (stream, name, at)
                files[file] += 1
                seen = set()
                for field, value in fields_of(rec):
                    if field not in seen:
                        carry[(*file, field)] += 1
                        seen.add(field)
                    shapes[(*file, field, json_type(value), "" if value is None else shape(value))] += 1
            rows = [(*k, None, None, None, n, 0, 0) for k, n in files.items()]
            rows += [(*k, None, None, 0, n, 0) for k, n in carry.items()]
            rows += [(*k, 0, 0, n) for k, n in shapes.items()]
            yield pd.DataFrame(rows, columns=["stream_name", "file_name", "written_at", "field", "type", "shape", "n_records", "n_carry", "n_type"])

    schema = "stream_name string, file_name string, written_at timestamp_ntz, field string, type string, shape string, n_records long, n_carry long, n_type long"
    typed = _deduplicated(lines).withColumn("written_at", F.col("written_at").cast("timestamp_ntz"))
    counted = typed.select("stream_name", "file_name", "written_at", "raw_line").mapInPandas(tally, schema)
    keys = ["stream_name", "file_name"]
    summed = counted.groupBy(*keys, "field", "type", "shape").agg(F.min("written_at").alias("written_at"), *(F.sum(c).alias(c) for c in ("n_records", "n_carry", "n_type")))
    per_type = summed.groupBy(*keys, "field", "type").agg(
        F.min("written_at").alias("written_at"), *(F.sum(c).alias(c) for c in ("n_records", "n_carry", "n_type")),
        F.map_from_entries(F.collect_list(F.when(F.col("shape") != "", F.struct("shape", "n_type")))).alias("shapes"),
    )
    by_file = W.partitionBy(*keys)
    by_field = W.partitionBy(*keys, "field")
    spread = per_type.withColumn("written_at", F.min("written_at").over(by_file)).withColumn("n_records", F.max("n_records").over(by_file)).withColumn("n_carry", F.max("n_carry").over(by_field))
    return spread.where("type is not null").select(*keys, "written_at", "n_records", "field", "type", "n_type", "n_carry", "shapes")


def same_content(a: dict[str, int], b: dict[str, int]) -> float:
    """The share in which two histograms of shapes agree; long texts agree if their lengths, by powers of two, are no more than one apart on average."""
    m, n = sum(a.values()) or 1, sum(b.values()) or 1
    agree = sum(min(c / m, b.get(s, 0) / n) for s, c in a.items() if not s.startswith("text "))
    long = [[(int(s[5:]), c) for s, c in h.items() if s.startswith("text ")] for h in (a, b)]
    if all(long):
        (p, x), (q, y) = ((sum(c for _, c in h), sum(k * c for k, c in h)) for h in long)
        agree += min(p / m, q / n) if abs(x / p - y / q) <= 1 else 0
    return agree


def file_changes(schemas: DataFrame) -> DataFrame:
    """(stream_name, file_name, change_type, old_field, new_field): each file against the one written before it in its stream.

    ``added`` (old_field ''), ``removed`` (new_field ''), ``renamed`` (a field goes and one of the same content comes; best agreement
    first, each field once), ``retyped`` (most non-null values have another JSON type; both names the same). A field that is
    null throughout has no type and can't be retyped. The first file of a stream has no change; equal times order by name.
    """
    keys = ["stream_name", "file_name"]
    # read by three branches
    schemas = staged(schemas, "schemas")
    main = F.struct(F.when(F.col("type") != "null", F.col("n_type")).otherwise(F.lit(-1)).alias("n"), "type")
    listed = F.collect_list(F.struct("type", F.coalesce("shapes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("shapes")))
    fields = schemas.where(F.col("n_carry") >= F.col("n_records") * FIELD_SHARE).groupBy(*keys, "field").agg(F.max(main)["type"].alias("type"), listed.alias("alternatives"))
    merged = F.aggregate("alternatives", F.array().cast("array<struct<key:string,value:bigint>>"), lambda acc, x: F.concat(acc, F.map_entries(x["shapes"])))
    fields = fields.select(*keys, "field", F.when(F.col("type") != "null", F.col("type")).alias("type"), merged.alias("shapes"))
    files = schemas.groupBy(*keys).agg(F.min("written_at").alias("written_at"))
    order = W.partitionBy("stream_name").orderBy("written_at", "file_name")
    followed = files.withColumn("next_file", F.lead("file_name").over(order)).withColumn("no", F.row_number().over(order))
    current = fields.join(followed.where("no > 1").select(*keys), keys).withColumn("side", F.lit("new"))
    before = fields.join(followed.where("next_file is not null").select(*keys, "next_file"), keys).select("stream_name", F.col("next_file").alias("file_name"), "field", "type", "shapes").withColumn("side", F.lit("old"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        def side(name: str) -> dict[str, tuple]:
            part = rows[rows.side == name]
            out = {}
            for f, t, s in zip(part.field, part.type, part.shapes, strict=True):
                hist: Counter = Counter()
                for e in s:
                    hist[e["key"]] += e["value"]
                out[f] = (t, hist)
            return out

        old, new = side("old"), side("new")
        gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
        pairs = sorted(((-same_content(old[a][1], new[b][1]), old[a][0] != new[b][0], a, b) for a in gone for b in come))
        out = []
        for agree, _, a, b in pairs:
            if -agree >= SAME_CONTENT and a in gone and b in come:
                gone.remove(a)
                come.remove(b)
                out.append(("renamed", a, b))
        out += [("removed", a, "") for a in gone] + [("added", "", b) for b in come]
        out += [("retyped", f, f) for f in sorted(old.keys() & new.keys()) if old[f][0] and new[f][0] and old[f][0] != new[f][0]]
        return pd.DataFrame([(*key, *x) for x in out], columns=["stream_name", "file_name", "change_type", "old_field", "new_field"])

    # a group is the fields of two files: bounded by what a tenth of a file's records can carry
    schema = "stream_name string, file_name string, change_type string, old_field string, new_field string"
    return current.unionByName(before).groupBy(*keys).applyInPandas(compare, schema)


def standard_names(changes: DataFrame) -> DataFrame:
    """(name, standard): every name that a standard field goes by, found by following the renames of all files from the standard names.

    In each round, names that a rename links with known ones take the standard field that most renames speak for (ties by name); names
    once known stay. Rounds end when a name is no longer found, so chains of renames of any length are followed.
    """
    spark = changes.sparkSession
    renames = changes.where("change_type = 'renamed'").select(F.col("old_field").alias("a"), F.col("new_field").alias("b"))
    links = staged(renames.unionByName(renames.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n")), "renames")
    known = spark.createDataFrame([(s, s) for s in STANDARD] + list(SAME_FIELD.items()), "name string, standard string")
    while True:
        offers = links.join(known.withColumnRenamed("name", "a"), "a").join(known.select(F.col("name").alias("b")), "b", "left_anti").groupBy("b", "standard").agg(F.sum("n").alias("n"))
        new = staged(offers.groupBy(F.col("b").alias("name")).agg(F.min(F.struct((-F.col("n")).alias("n"), "standard"))["standard"].alias("standard")), "names")
        if not new.limit(1).count():
            return known
        known = staged(known.unionByName(new), "known")


def standard_focuses(lines: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row per focus of each record: file and line, focus_no, the ten standard fields as strings or numbers, and ``branches``.

    Fields are known by the names that the renames in ``changes`` (by default those of the lines' own files) lead to. ``branches`` keeps for each
    standard field the name, JSON type and JSON value that it came with, a typed branch of the union; the columns
    hold its canonical conversion: wrappers of one value opened, year and source_id as integers where the whole text is
    one, quarters as ``Q`` and a digit, document types upper case. What can't be converted is null there and kept in its branch. Records without a focus
    give no row; of several names for one standard field the first in the record that is not null counts.
    """
    names = standard_names(file_changes(file_schemas(lines)) if changes is None else changes)
    rows = names.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} field names")
    standard = lines.sparkSession.sparkContext.broadcast({r["name"]: r["standard"] for r in rows})

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = standard.value

        def plain(v: object) -> str | None:
            while isinstance(v, list | dict):
                inner = v if isinstance(v, list) else list(v.values())
                v = inner[0] if inner else None
            return None if v is None or str(v).strip() == "" else str(v).strip()

        for b in batches:
            rows = []
            for stream, name, no, line in zip(b.stream_name, b.file_name, b.line_no, b.raw_line, strict=True):
                rec = record(line)
                if rec is None:
                    continue
                meta, focuses = focus_parts(rec)
                if not focuses and known.keys() & meta.keys():
                    focuses = [meta]
                for i, f in enumerate(focuses):
                    values, branches = dict.fromkeys(STANDARD), {}
                    # a standard name goes before the others
                    for field in sorted(f, key=lambda k: k not in values):
                        c = known.get(field)
                        if c and f[field] is not None and c not in branches:
                            values[c] = plain(f[field])
                            branches[c] = {"field": field, "type": json_type(f[field]), "value": json.dumps(f[field], ensure_ascii=False)}
                    for c in ("year", "source_id"):
                        v = values[c]
                        values[c] = int(v) if v and re.fullmatch(r"[-+]?\d{1,18}", v) else None
                    for c in ("quarter", "raw_quarter"):
                        m = re.fullmatch(r"[qQ]?([1-4])", values[c] or "")
                        values[c] = f"Q{m[1]}" if m else None
                    values["quarter"] = values["quarter"] or values["raw_quarter"]
                    if values["normalized_doc_type"]:
                        values["normalized_doc_type"] = values["normalized_doc_type"].upper().replace("_", " ").strip()
                    rows.append((stream, name, no, i, *(values[c] for c in STANDARD), branches))
            frame = pd.DataFrame(rows, columns=["stream_name", "file_name", "line_no", "focus_no", *STANDARD, "branches"])
            for c in ("year", "source_id", "line_no"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    types = {"year": "int", "source_id": "long"}
    schema = "stream_name string, file_name string, line_no int, focus_no int, " + ", ".join(f"{c} {types.get(c, 'string')}" for c in STANDARD) + ", branches map<string,struct<field:string,type:string,value:string>>"
    return _deduplicated(lines).select("stream_name", "file_name", "line_no", "raw_line").mapInPandas(convert, schema)
