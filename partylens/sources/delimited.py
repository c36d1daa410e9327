"""Scans of messy delimited lists: bytes in, typed parties out, with rejects and drift reported.

Lines are read as bytes and streamed, file by file, through Python's reader, which decodes (UTF-8 with or without mark,
Windows-1252, Latin-1) and gives records with ordinals, which Spark's CSV source doesn't keep. Everything after that is columns.
"""

from __future__ import annotations

import csv
import io
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partylens.operators.rules import clean, party_type, split_multi
from partylens.storage import cut

#: Columns of the headerless lists, by place.
SDN = "ent_num name type program title call_sign vess_type tonnage grt vess_flag vess_owner remarks".split()
ALT = "ent_num alt_num alt_type alt_name alt_remarks".split()
ADD = "ent_num add_num address city_state_zip country remarks".split()
SDN_TYPES = ("individual", "vessel", "aircraft", "")
#: Canonical party-file fields and the headers that stand for them.
PARTY_FIELDS = {
    "ref": "ref id reference customer_id party_id", "name": "name party_name customer company full_name", "party_type": "party_type type kind", "country": "country country_code nation",
    "address": "address street full_address", "role": "role relationship", "aliases": "aliases aka alt_names", "destination_country": "destination_country destination ship_to_country",
    "eccn": "eccn classification", "item_description": "item_description item product goods", "end_use": "end_use enduse purpose",
}
NAME_LIMIT, ALIAS_LIMIT = 256, 50


#: A file has the first of these encodings that all its bytes fit; Latin-1 fits any.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
BOM = b"\xef\xbb\xbf"
_BATCH = 5_000


def parser(delimiter: str):
    """Records of files, from batches of their lines in order; only a batch and a record are held at a time."""

    def run(batches):
        import pyarrow as pa

        csv.field_size_limit(1 << 27)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "kind", "line"))))
        out: list[tuple] = []

        def flush():
            columns = zip(*out)
            made = pa.RecordBatch.from_arrays([pa.array(next(columns), t) for t in (pa.int32(), pa.int32(), pa.list_(pa.string()))], names=["file", "row_no", "fields"])
            out.clear()
            return made

        for (file, kind), lines in groupby(rows, lambda r: r[:2]):
            for i, fields in enumerate(csv.reader(_text((r[2] for r in lines), kind), delimiter=delimiter), 1):
                if fields:
                    out.append((file, i, fields))
                    if len(out) == _BATCH:
                        yield flush()
        if out:
            yield flush()

    return run


def _text(lines, kind: int):
    """Pieces of a file's text that end where the CSV reader expects it: at line feeds, returns and both.

    ``kind`` holds the encoding's place, 4 if the last line lacks its line feed, 8 if the source took a byte order mark off.
    """
    encoding = ENCODINGS[kind & 3]
    line = BOM if kind & 8 and encoding != "utf-8" else b""
    after = b""
    for more in lines:
        if after:
            yield from io.StringIO((line + after).decode(encoding), newline="")
            line = b""
        line, after = line + more, b"\n"
    yield from io.StringIO((line + (b"" if kind & 4 else b"\n")).decode(encoding), newline="")


def records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(path, row_no, fields, encoding) of every record of every file under ``path``.

    A file's lines are brought together in order and streamed through one reader, so that neither a file nor its records
    have to fit in memory.
    """
    value, whole = F.col("value"), F.octet_length("value") + 1
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), value)
    # bytes that Windows-1252 has no character for
    odd = F.when(F.is_valid_utf8(value), False).otherwise(F.decode(value.cast("binary"), "ISO-8859-1").rlike(r"[\x81\x8d\x8f\x90\x9d]"))
    facts = lines.groupBy("at").agg(F.sum(whole).alias("bytes"), F.bool_and(F.is_valid_utf8(value)).alias("utf8"), F.bool_or(odd).alias("odd"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("at"), "path", "length")
    known = files.join(facts, "at").withColumn("file", F.row_number().over(Window.orderBy("path")))
    extra = F.col("length") - F.col("bytes")
    kind = F.when(F.col("utf8"), 0).when(~F.col("odd"), 1).otherwise(2) + F.when(extra.isin(-1, 2), 4).otherwise(0) + F.when(extra.isin(2, 3), 8).otherwise(0)
    known = cut(known.select("at", "path", "file", kind.cast("int").alias("kind")))  # a row a file
    sent = lines.join(F.broadcast(known), "at").select("file", "kind", "start", "place", value.cast("binary").alias("line"))
    sent = sent.repartition("file").sortWithinPartitions("file", "start", "place").select("file", "kind", "line")
    parsed = sent.mapInArrow(parser(delimiter), "file int, row_no int, fields array<string>")
    told = F.element_at(F.array(*[F.lit(e) for e in ("utf-8-sig", *ENCODINGS[1:])]), F.col("kind").bitwiseAND(3) + 1)
    # a file is one task up to here; its records go to all cores, and are kept as they are read for their header too
    return cut(parsed.repartition("file", "row_no").join(F.broadcast(known), "file").select("path", "row_no", "fields", told.alias("encoding")))


def headers_of(fields: Column) -> Column:
    """Headers in lower case, all but letters and digits as single underscores."""
    return F.transform(fields, lambda h: F.trim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", "_"), F.lit("_")))


def headed(rows: DataFrame) -> DataFrame:
    """Records with their file's header beside them; ragged ones are marked."""
    head = rows.filter("row_no = 1").select(F.col("path").alias("p"), headers_of(F.col("fields")).alias("header"))
    body = rows.filter("row_no > 1").join(F.broadcast(head), rows["path"] == head["p"]).drop("p")
    ragged = F.size("fields") != F.size("header")
    same = F.transform("header", lambda h, i: F.get(F.col("fields"), i))
    return body.withColumn("ragged", ragged).withColumn("raw", F.map_filter(F.map_from_arrays("header", same), lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != ""))


def field(aliases: str) -> Column:
    """The first header alias that the row's file has."""
    return F.coalesce(*[F.element_at("raw", F.lit(a)) for a in aliases.split()])


def unmapped(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Headers that no canonical field takes."""
    known = [a for v in fields.values() for a in v.split()]
    return rows.filter("row_no = 1").select("path", F.explode(headers_of(F.col("fields"))).alias("header")).filter(~F.col("header").isin(known))


def party_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(subjects, warnings): an operator's own parties, blank names left out and told."""
    rows = headed(records(spark, path))
    got = rows.select("path", "row_no", "ragged", *[clean(field(v)).alias(k) for k, v in PARTY_FIELDS.items()])
    subjects = got.filter("name <> ''").select(
        F.when(F.col("ref") != "", F.col("ref")).otherwise(F.concat(F.lit("row"), "row_no")).alias("ref"), F.substring("name", 1, NAME_LIMIT).alias("name"),
        F.when(F.col("party_type").isin(*"aircraft entity individual vessel".split()), F.col("party_type")).otherwise("unknown").alias("party_type"), "country", "address", "role",
        F.slice(split_multi(F.col("aliases")), 1, ALIAS_LIMIT).alias("aliases"), F.when(F.col("destination_country") != "", F.col("destination_country")).otherwise(F.col("country")).alias("destination_country"), "eccn", "item_description", "end_use",
    )
    why = F.filter(F.array(F.when(F.col("name") == "", "blank name"), F.when(F.col("ragged"), "ragged row"), F.when(F.length("name") > NAME_LIMIT, "name cut"), F.when(F.size(split_multi(F.col("aliases"))) > ALIAS_LIMIT, "aliases cut")), lambda x: x.isNotNull())
    return subjects, got.select("path", "row_no", F.explode(why).alias("warning"))


def sdn(spark: SparkSession, path: str, code: str = "SDN") -> DataFrame:
    """Parties of the headerless twelve-column list; rows of under four fields are skipped."""
    x = records(spark, path).filter(F.size("fields") >= 4).select("row_no", *[clean(F.get(F.col("fields"), i)).alias(c) for i, c in enumerate(SDN)]).filter("name <> ''")
    return x.select(
        F.concat(F.lit(code + ":"), "ent_num").alias("uid"), F.lit(code).alias("source"), F.col("ent_num").alias("native_id"), "name", party_type(F.col("type")).alias("party_type"), "remarks",
        F.filter(F.transform(F.split("program", r"[;\]\[]+"), lambda p: F.trim(p)), lambda p: p != "").alias("programs"), F.col("row_no").alias("ord"),
    )


def with_side_files(parties: DataFrame, spark: SparkSession, alt_path: str, add_path: str) -> DataFrame:
    """Aliases and addresses joined on the entity number, in file order; countries from the addresses."""
    alt = records(spark, alt_path).filter(F.size("fields") >= 4).select(clean(F.get("fields", F.lit(0))).alias("native_id"), "row_no", clean(F.get("fields", F.lit(3))).alias("v")).filter("v <> ''")
    add = records(spark, add_path).filter(F.size("fields") >= 5).select(
        clean(F.get("fields", F.lit(0))).alias("native_id"), "row_no", *[clean(F.get("fields", F.lit(i))).alias(n) for i, n in ((2, "a"), (3, "b"), (4, "c"))]
    )
    line = F.array_join(F.filter(F.array("a", "b", "c"), lambda x: x != ""), ", ")
    ordered = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("row_no", v.alias("v")))), lambda x: x["v"])
    aliases = alt.groupBy("native_id").agg(ordered(F.col("v")).alias("aliases"))
    addresses = add.groupBy("native_id").agg(ordered(line).alias("addresses"), F.array_distinct(F.filter(ordered(F.col("c")), lambda x: x != "")).alias("countries"))
    none = F.array().cast("array<string>")
    out = parties.join(aliases, "native_id", "left").join(addresses, "native_id", "left")
    return out.select(*parties.columns, *[F.coalesce(c, none).alias(c) for c in ("aliases", "addresses", "countries")])


def orphan_aliases(parties: DataFrame, spark: SparkSession, alt_path: str) -> DataFrame:
    alt = records(spark, alt_path).filter(F.size("fields") >= 4).select(clean(F.get("fields", F.lit(0))).alias("native_id"))
    return alt.join(parties, "native_id", "left_anti").distinct()


def drift(spark: SparkSession, path: str, share: float = 0.6, least: int = 5) -> DataFrame:
    """Whether the type column still holds types: a shifted layout shows there first."""
    kind = F.lower(clean(F.get("fields", F.lit(2))))
    one = records(spark, path).agg(F.count("*").alias("rows"), F.count_if(kind.isin(*SDN_TYPES)).alias("known"))
    return one.withColumn("drifted", (F.col("rows") >= least) & (F.col("known") / F.col("rows") < share))


def dedupe(parties: DataFrame) -> DataFrame:
    """One row for each uid: the first wins; aliases, addresses and countries of all are merged without regard to case."""
    order = Window.partitionBy("uid").orderBy("ord")
    first = parties.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn", "aliases", "addresses", "countries", "remarks")
    merged = []
    for c in ("aliases", "addresses", "countries"):
        one = parties.select("uid", "ord", F.posexplode(c).alias("pos", "v")).withColumn("rn", F.row_number().over(Window.partitionBy("uid", F.lower("v")).orderBy("ord", "pos"))).filter("rn = 1")
        merged.append(one.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "v"))), lambda x: x["v"]).alias(c)))
    remarks = parties.filter("remarks <> ''").groupBy("uid").agg(F.min_by("remarks", "ord").alias("remarks"))
    out = first
    for one in [*merged, remarks]:
        out = out.join(one, "uid", "left")
    return out

#: Fields of the headed lists and the headers that stand for them.
LIST_FIELDS = {
    "native_id": "entity_number entity_num", "row_id": "id _id", "source_label": "source source_list list", "name": "name entity_name listed_name", "party_type": "type entity_type sdn_type", "programs": "programs program sanctions_programs",
    "aliases": "alt_names alternate_names aka alt_name alias aliases alternate_name", "addresses": "addresses address street_address", "city": "city", "state": "state", "postal_code": "postal_code", "countries": "countries country nationalities citizenships",
    "remarks": "remarks notes comment", "action": "action", "standard_order": "standard_order", "federal_register": "federal_register_notice fr_citation federal_register", "begin": "start_date effective_date date", "end": "end_date expiration_date",
    "source_url": "source_list_url source_information_url url", "license_requirement": "license_requirement license_requirements", "license_policy": "license_policy license_review_policy", "ids": "ids identifications id_numbers",
    "dates_of_birth": "dates_of_birth date_of_birth dob", "places_of_birth": "places_of_birth place_of_birth pob", "title": "title", "call_sign": "call_sign", "vessel_flag": "vessel_flag", "vessel_owner": "vessel_owner", "vessel_type": "vessel_type",
}
#: What tells two of the same name apart is put among the ids, under these labels.
DISCRIMINATORS = {"dates_of_birth": "DOB", "places_of_birth": "POB", **{c: c.replace("_", " ") for c in ("title", "call_sign", "vessel_flag", "vessel_owner", "vessel_type")}}
_BIS, _TREASURY, _STATE = (f" - {x}" for x in ("bureau of industry and security", "treasury department", "state department"))
#: Exact labels only: a near miss is UNKNOWN, never a neighbour's list.
LABELS = {
    **{x: "DPL" for x in ("denied persons list", "denied persons list (dpl)" + _BIS)}, **{x: "EL" for x in ("entity list", "entity list (el)" + _BIS)},
    **{x: "UVL" for x in ("unverified list", "unverified list (uvl)" + _BIS)}, **{x: "MEU" for x in ("military end user list", "military end user (meu) list" + _BIS)},
    **{x: "SDN" for x in ("sdn", "specially designated nationals (sdn)" + _TREASURY, "specially designated nationals list (sdn)" + _TREASURY)},
    **{x: "NONSDN" for x in ("capta list", "sectoral sanctions identifications list (ssi)" + _TREASURY, "foreign sanctions evaders (fse)" + _TREASURY)},
    **{f"non-sdn {x}": "NONSDN" for x in ("menu-based sanctions list (ns-mbs list)", "chinese military-industrial complex companies list (ns-cmic)", "palestinian legislative council list (ns-plc)")},
    "itar debarred (dtc)" + _STATE: "DTC", "nonproliferation sanctions (isn)" + _STATE: "ISN",
}
EFFECT = {"DPL": "no participation", "SDN": "blocked", "NONSDN": "partly restricted", "EL": "license needed", "MEU": "license needed", "UVL": "statement needed", "ISN": "sanctioned", "DTC": "debarred"}


def list_code(label: Column) -> Column:
    """The list code of a label: exact but for case and blanks, UNKNOWN otherwise."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " "))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), key), F.lit("UNKNOWN"))


def effect(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in EFFECT.items() for x in p]), code), F.lit("unknown list: treat as restricted until told"))


def headed_list(spark: SparkSession, path: str, delimiter: str = ",", code: str | None = None, ordinal_ids: bool = False, forced_type: str | None = None, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(parties, rejects) of a list with a header; blank names are rejected, ordinals count them too.

    ``code`` names a single-list file; without it the source column decides, and ``only`` keeps one list of several.
    ``ordinal_ids`` makes the row ordinal the id, as for the tab-delimited orders list, beside a hash of the content
    that outlives a reissue. A file without a name column is refused.
    """
    read = records(spark, path, delimiter)
    known = F.exists(headers_of(F.col("fields")), lambda h: h.isin(*LIST_FIELDS["name"].split()))
    nameless = [r["path"] for r in read.filter("row_no = 1").filter(~known).select("path").limit(3).collect()]
    if nameless:
        raise ValueError(f"no name column in {nameless}")
    rows = headed(read)
    got = rows.select("path", "row_no", "raw", *[clean(field(v)).alias(k) for k, v in LIST_FIELDS.items()])
    source = F.lit(code) if code else list_code(F.col("source_label"))
    ordinal = (F.col("row_no") - 1).cast("string")
    given = F.coalesce(F.nullif("native_id", F.lit("")), F.nullif("row_id", F.lit("")))
    native = ordinal if ordinal_ids else F.coalesce(given, F.concat(F.lit("row"), F.col("row_no") - 2))
    notes = F.array("remarks", "action", *[F.when(F.col(c) != "", F.concat(F.lit(c.replace("_", " ") + ": "), F.col(c))).otherwise("") for c in ("license_requirement", "license_policy")])
    place = F.array_join(F.filter(F.array("addresses", "city", "state", "postal_code", "countries"), lambda x: x != ""), ", ")
    # an orders list has its address in parts, which make one line
    addresses = F.when((F.col("city") != "") | (F.col("state") != "") | (F.col("postal_code") != ""), F.filter(F.array(place), lambda x: x != "")).otherwise(split_multi(F.col("addresses")))
    under = lambda label: lambda v: F.concat(F.lit(f"{label}: "), v)
    labelled = F.flatten(F.array(*[F.transform(split_multi(F.col(c)), under(n)) for c, n in DISCRIMINATORS.items()]))
    parties = got.filter("name <> ''").select(
        F.concat_ws(":", source, native).alias("uid"), source.alias("source"), native.alias("native_id"), "name", (F.lit(forced_type) if forced_type else party_type(F.col("party_type"))).alias("party_type"),
        split_multi(F.col("aliases")).alias("aliases"), addresses.alias("addresses"), *[split_multi(F.col(c)).alias(c) for c in ("countries", "programs")], F.concat(split_multi(F.col("ids")), labelled).alias("ids"),
        F.array_join(F.filter(notes, lambda x: x != ""), " | ").alias("remarks"), "federal_register", "begin", "end", "standard_order", "source_url", F.col("row_no").alias("ord"),
        F.sha2(F.concat_ws("|", F.map_values("raw")), 256).alias("content_hash"),
    )
    return (parties.filter(F.col("source") == only) if only else parties), got.filter("name = ''").select("path", "row_no")


def ragged_report(spark: SparkSession, path: str, delimiter: str = ",", most: int = 3) -> DataFrame:
    """(path, ragged, first): how many rows of each file differ from its header, and the first of them described."""
    bad = headed(records(spark, path, delimiter)).filter("ragged")
    told = F.concat(F.lit("row "), F.col("row_no"), F.lit(": "), F.size("fields"), F.lit(" of "), F.size("header"), F.lit(" fields"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("row_no"))
    some = bad.withColumn("place", place).groupBy("path").agg(F.count("*").alias("ragged"), F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("row_no", told.alias("told"))))).alias("first"))
    return some.select("path", "ragged", F.array_join(F.transform("first", lambda x: x["told"]), "; ").alias("first"))


def odd_widths(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, columns) of the headerless list's rows that don't have its twelve columns."""
    return records(spark, path).filter(F.size("fields") != len(SDN)).select("row_no", F.size("fields").alias("columns"))


def parse_cached(spark: SparkSession, folder: str, codes: list[str]) -> DataFrame:
    """All parties of the cached files of several lists, one folder a code, without repeated uids.

    SDN takes its side files SDN_ALT and SDN_ADD in; these give no parties of their own.
    """
    parts = []
    for code in codes:
        at = f"{folder}/{code}"
        if code in ("SDN", "NONSDN"):
            one = sdn(spark, at, code)
            if {"SDN_ALT", "SDN_ADD"} <= set(codes) and code == "SDN":
                one = with_side_files(one, spark, f"{folder}/SDN_ALT", f"{folder}/SDN_ADD")
        elif code in ("SDN_ALT", "SDN_ADD"):
            continue
        elif code == "DPL":
            one = headed_list(spark, at, "\t", code="DPL", ordinal_ids=True)[0]
        elif code in ("EL", "UVL", "MEU"):
            one = headed_list(spark, at, code=code, forced_type="entity")[0]
        else:
            one = headed_list(spark, at)[0]
        parts.append(one)
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    none = F.array().cast("array<string>")
    for c in ("aliases", "addresses", "countries"):
        every = every.withColumn(c, F.coalesce(c, none) if c in every.columns else none)
    return dedupe(every)


def unknown_labels(spark: SparkSession, path: str) -> DataFrame:
    """Source labels without a list code, which are told."""
    got = headed(records(spark, path)).select(clean(field(LIST_FIELDS["source_label"])).alias("label"))
    return got.filter(list_code(F.col("label")) == "UNKNOWN").groupBy("label").agg(F.count("*").alias("n"))
