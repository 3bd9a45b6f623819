"""Readers and writers of contract files: delimited text, JSON in its several shapes, and raw exports."""

from __future__ import annotations

import codecs
import csv
import io
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import parse
from ..functions.values import RAW_COLUMNS

#: Bytes of a file that are looked at to tell its encoding and delimiter.
SNIFF_BYTES = 2 << 20
THAI = "x-windows-874"
# Other headers under which a field is known.
ALIASES = {
    "project_id": ("projectid", "รหัสโครงการ", "เลขที่โครงการ"), "project_name": ("projectname", "ชื่อโครงการ", "ชื่องาน"),
    "dept_name": ("deptname", "department", "หน่วยงาน", "ชื่อหน่วยงาน"), "winner_name": ("winnername", "ผู้รับจ้าง", "ผู้ชนะ", "ผู้ชนะการเสนอราคา", "คู่สัญญา"),
    "contract_price_agree": ("ราคาที่ตกลงซื้อหรือจ้าง", "ราคาที่ตกลง", "มูลค่าสัญญา", "contract_price"), "contract_date": ("วันที่ทำสัญญา", "วันทำสัญญา", "วันที่ลงนาม"),
    "price_build": ("ราคากลาง", "ราคาอ้างอิง"), "project_money": ("วงเงินโครงการ", "งบประมาณโครงการ", "วงเงินงบประมาณ"), "sum_price_agree": ("ยอดรวม", "ราคารวม"),
    "purchase_method_name": ("วิธีจัดหา", "วิธีการจัดซื้อจัดจ้าง", "วิธีซื้อหรือจ้าง"), "purchase_method_group_name": ("กลุ่มวิธีจัดหา", "ประเภทวิธีจัดหา"),
    "project_type_name": ("ประเภทโครงการ", "ประเภทงาน"), "province": ("จังหวัด",), "winner_tin": ("tin", "เลขประจำตัวผู้เสียภาษี", "เลขผู้เสียภาษี"),
    "contract_no": ("เลขที่สัญญา", "สัญญาเลขที่"), "project_location": ("location", "geometry", "wkt", "พิกัด", "ที่ตั้งโครงการ"),
    "dept_sub_name": ("หน่วยงานย่อย", "สำนัก/กอง"), "district": ("อำเภอ", "เขต"), "subdistrict": ("ตำบล", "แขวง"), "announce_date": ("วันที่ประกาศ", "วันประกาศ"),
    "contract_finish_date": ("วันที่สิ้นสุดสัญญา", "วันสิ้นสุด", "วันแล้วเสร็จ"), "budget_year": ("ปีงบประมาณ", "ปีงบ", "fiscal_year"),
    "lat": ("latitude", "ละติจูด"), "lon": ("lng", "longitude", "ลองจิจูด"),
}
REQUIRED = ("project_id", "project_name", "dept_name", "winner_name", "contract_price_agree", "contract_date")
MONEY = ("project_money", "price_build", "sum_price_agree", "contract_price_agree")
DATES = ("announce_date", "contract_date", "contract_finish_date")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file as bytes, in a column line; large files are read in parts."""
    options = {"encoding": "ISO-8859-1", "sep": "\x01", "quote": "\x02", "escape": "\x02", "maxCharsPerColumn": -1}
    return spark.read.schema("text string").options(**options).csv(path).select(F.encode(F.coalesce("text", F.lit("")), "ISO-8859-1").alias("line"))


def head(spark: SparkSession, path: str, lines: int = 200) -> bytes:
    """The first lines of a path."""
    first = b"\n".join(bytes(r["line"]) for r in raw_lines(spark, path).limit(lines).collect())[:SNIFF_BYTES]
    if not first.startswith((b"\xff\xfe", b"\xfe\xff")):
        return first
    # Two-byte characters don't part at line feeds as bytes do: such a file is opened whole.
    got = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, SNIFF_BYTES).alias("b")).limit(1).collect()
    return bytes(got[0]["b"])


def whole_file(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether all lines are UTF-8, and whether any has an odd number of quotes, so that a value may run on; one pass."""
    quotes = F.length("line") - F.length(F.encode(F.replace(F.decode("line", "ISO-8859-1"), F.lit('"'), F.lit("")), "ISO-8859-1"))
    got = raw_lines(spark, path).agg(F.count_if(~F.is_valid_utf8(F.col("line").cast("string"))), F.count_if(quotes % 2 == 1)).first()
    return got[0] == 0, got[1] > 0


def sniff_encoding(raw: bytes) -> str:
    """A byte-order mark, else UTF-8 if it decodes, else the Thai code page."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if raw.startswith(mark):
            return name
    try:  # where the file is longer, the last character may be cut
        codecs.getincrementaldecoder("utf-8")().decode(raw, final=len(raw) < SNIFF_BYTES)
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    return THAI


def sniff_delimiter(text: str) -> str:
    """Of comma, semicolon, tab and bar, the one whose count in the first line most of the next nine repeat."""
    lines = [x for x in text.splitlines() if x.strip()][:10]
    if not lines:
        return ","

    def worth(d: str) -> float:
        counts = [len(next(csv.reader(io.StringIO(x), delimiter=d))) - 1 for x in lines]
        return counts[0] * sum(c == counts[0] for c in counts) / len(counts)

    best = max(",;\t|", key=worth)
    return best if worth(best) > 0 else ","


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """All columns as strings; short rows end in nulls, and _corrupt holds rows that don't fit the header. Files are read
    in parts but where a quoted value runs on over lines, or in UTF-16."""
    raw = head(spark, path)
    told = sniff_encoding(raw)
    utf8, runs_on = (True, True) if told.startswith("UTF-16") else whole_file(spark, path)
    encoding = encoding or (told if utf8 or told != "UTF-8" else THAI)
    text = raw.decode({THAI: "cp874"}.get(encoding, encoding), "replace").lstrip("﻿")
    delimiter = delimiter or sniff_delimiter(text)
    header = next(csv.reader(io.StringIO(text), delimiter=delimiter), [])
    schema = StructType([StructField(h.strip() or f"column_{i}", StringType()) for i, h in enumerate(header)] + [StructField("_corrupt", StringType())])
    options = {"header": True, "enforceSchema": True, "multiLine": runs_on, "quote": '"', "escape": '"', "encoding": encoding, "sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "nullValue": "\x00"}
    if encoding != THAI:
        return spark.read.schema(schema).options(**options).csv(path)
    # The reader doesn't know the Thai code page: bytes come in as Latin-1 and their characters are exchanged.
    rows = spark.read.schema(schema).options(**options | {"encoding": "ISO-8859-1"}).csv(path)
    bytes_ = [b for b in range(0x80, 0x100) if bytes([b]).decode("cp874", "ignore")]
    page = "".join(map(chr, bytes_)), bytes(bytes_).decode("cp874")
    return rows.select(*[F.translate(F.col(f"`{c}`"), *page).alias(c) for c in rows.columns])


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file: an array of rows, or an object that holds them as records, data, result or result.records."""
    whole = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    names = whole.columns
    if "records" in names:
        return whole.select(F.explode("records").alias("r")).select("r.*")
    if "data" in names and dict(whole.dtypes)["data"].startswith("array"):
        return whole.select(F.explode("data").alias("r")).select("r.*")
    if "result" in names:
        inner = "result" if dict(whole.dtypes)["result"].startswith("array") else "result.records"
        return whole.select(F.explode(inner).alias("r")).select("r.*")
    return whole


def _plain(header: str) -> str:
    return "".join(c for c in header.lower() if c not in " \t_-.()")


def guess_mapping(headers: Iterable[str]) -> tuple[dict[str, str | None], float]:
    """Each field's header, exact names before contained ones and each header once; the share of required fields found."""
    left, out = list(headers), {}
    for field in dict.fromkeys([*RAW_COLUMNS, "lat", "lon"]):
        names = [_plain(x) for x in (field, *ALIASES.get(field, ()))]
        exact = [h for h in left if _plain(h) in names]
        inside = [h for h in left if any(len(n) >= 4 and n in _plain(h) for n in names)]
        out[field] = (exact or inside or [None])[0]
        if out[field]:
            left.remove(out[field])
    return out, sum(bool(out[f]) for f in REQUIRED) / len(REQUIRED)


def normalize(raw: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Raw rows to the contract schema; rows with neither project id nor name go, fields without a header are null or empty."""
    src = lambda f: F.col(f"`{mapping[f]}`") if mapping.get(f) else F.lit(None).cast("string")
    text = lambda f: F.coalesce(parse.trim(src(f)), F.lit(""))
    out: dict[str, Column] = {f: text(f) for f in RAW_COLUMNS if f not in MONEY + DATES}
    out |= {f: parse.money(src(f)) for f in MONEY} | {f: parse.thai_date(src(f))[0] for f in DATES}
    df = raw.select(*[v.alias(k) for k, v in out.items()], parse.wkt_point(src("project_location")).alias("_geo"), src("lat").try_cast("double").alias("_lat"), src("lon").try_cast("double").alias("_lon"))
    df = df.filter((F.col("project_id") != "") | (F.col("project_name") != ""))
    return df.select(
        *out, F.coalesce("_geo.lat", "_lat").alias("lat"), F.coalesce("_geo.lon", "_lon").alias("lon"), F.col("_geo.geom_type").alias("geom_type"), parse.squeeze(F.col("dept_name")).alias("dept_key"), parse.canonical_name(F.col("winner_name")).alias("winner_key"),
        parse.is_joint_venture(F.col("winner_name")).alias("is_jv"), parse.is_masked(F.col("winner_tin")).alias("tin_is_masked"), F.datediff("contract_finish_date", "contract_date").alias("duration_days"), F.datediff("contract_date", "announce_date").alias("announce_gap_days"), parse.first_group(F.col("project_name")).alias("work_group"),
    )


def with_geo_quality(c: DataFrame, least: int = 3) -> DataFrame:
    """c with geo_quality: none without a place, shared where several names stand at one text of it, else ok."""
    shared = c.filter(F.col("project_location") != "").groupBy("project_location").agg(F.count("*").alias("_n"), F.count_distinct("project_name").alias("_names")).filter((F.col("_n") >= least) & (F.col("_names") >= least))
    quality = F.when(F.col("lat").isNull(), "none").when(F.col("_n").isNotNull(), "shared").otherwise("ok")
    return c.join(shared, "project_location", "left").withColumn("geo_quality", quality).drop("_n", "_names")


def to_raw(c: DataFrame) -> DataFrame:
    """Contracts as the raw columns of text, dates in the Buddhist era."""
    place = F.when(F.col("project_location") != "", F.col("project_location")).otherwise(parse.point_wkt(F.col("lat"), F.col("lon")))
    out = {x: F.coalesce(F.col(x).cast("string"), F.lit("")) for x in RAW_COLUMNS if x not in DATES} | {x: parse.to_thai_date(F.col(x)) for x in DATES} | {"project_location": place}
    return c.select(*[out[x].alias(x) for x in RAW_COLUMNS])


def write_delimited(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines without NaN or infinity: those become null."""
    real = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    clean = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in real}
    (df.withColumns(clean) if clean else df).write.mode("error").json(path)


def parse_directors(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines of tax number, company, person and role, cut at tabs or else commas, to distinct rows; and the bad lines."""
    cells = F.transform(F.split(F.col(column), F.when(F.col(column).contains("\t"), "\t").otherwise(",")), parse.trim)
    cut = lines.select(F.col(column).alias("line"), cells.alias("c")).filter(parse.trim(F.col("line")) != "")
    good = (F.size("c") >= 3) & (F.get("c", F.lit(0)) != "") & (F.get("c", F.lit(2)) != "")
    names = ("tax_id", "company_name", "person_name", "role")
    rows = cut.filter(good).select(*[F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
    return rows.dropDuplicates(["tax_id", "person_name", "role"]), cut.filter(~good).select("line")


def ragged(df: DataFrame) -> DataFrame:
    """One row: rows read, and those longer or shorter than the header."""
    values = [c for c in df.columns if c != "_corrupt"]
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("_corrupt").isNotNull()).alias("n_ragged"), F.count_if(F.col(f"`{values[-1]}`").isNull()).alias("n_short"))


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """A contract file of any kind that is known: JSON by suffix or first character, else delimited text."""
    first = head(spark, path, 5).decode("utf-8", "replace").lstrip("\ufeff \t\r\n")[:1]
    return read_json_rows(spark, path) if path.lower().endswith(".json") or first in ("[", "{") else read_delimited(spark, path)


def rows_of_text(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a JSON text that was pasted: an array of rows or one row."""
    found = json.loads(text)
    found = found if isinstance(found, list) else [found]
    names = list(dict.fromkeys(k for r in found for k in r))
    cell = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return spark.createDataFrame([tuple(cell(r.get(k)) for k in names) for r in found], StructType([StructField(n, StringType()) for n in names]))


def deep_status(meta: dict, generated_at: str, n_records: int, schema: str = "deep_pattern/2") -> str:
    """Of scores kept beside a table: unavailable under another schema, stale if made from other data, else ready."""
    if meta.get("schema") != schema:
        return "unavailable"
    return "ready" if meta.get("data_generated_at") == generated_at and meta.get("n_records") == n_records else "stale"


def replace_table(df: DataFrame, path: str) -> None:
    """df in place of the table at path, by way of a folder beside it: a failed write leaves the old table as it was."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    fs_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(fs_path(path), True)
    if not fs.rename(fs_path(f"{path}.new"), fs_path(path)):
        raise OSError(f"{path}.new could not be renamed")


def payload(meta: dict) -> str:
    """Metadata as JSON text; NaN raises."""
    return json.dumps(meta, ensure_ascii=False, allow_nan=False, sort_keys=True)
