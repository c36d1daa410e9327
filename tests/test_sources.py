import pytest

from partylens.sources import delimited as D
from partylens.sources import snapshot as S
from partylens.sources import sinks as K
from pyspark.sql import functions as F


def test_party_file(spark, tmp_path):
    text = 'Customer ID,Company,Country,AKA,Extra\n7,"Müller, Söhne",DE,"a; b|c",x\n,Zeta,FR,,\n8,,US,,\n9,"two\nlines",US\n'
    (tmp_path / "p.csv").write_bytes(text.encode("cp1252"))
    subjects, warnings = D.party_file(spark, str(tmp_path))
    got = {r["ref"]: r for r in subjects.collect()}
    assert set(got) == {"7", "row3", "9"}
    assert got["7"]["name"] == "Müller, Söhne" and got["7"]["aliases"] == ["a", "b", "c"] and got["9"]["name"] == "two\nlines"
    assert got["7"]["destination_country"] == "DE"
    assert {(r["row_no"], r["warning"]) for r in warnings.collect()} == {(4, "blank name"), (5, "ragged row")}
    assert [r["header"] for r in D.unmapped(D.records(spark, str(tmp_path)), D.PARTY_FIELDS).collect()] == ["extra"]


def test_records_are_streamed_and_the_same_as_of_whole_files(spark, tmp_path):
    """Against the reader on whole files: marks, encodings, returns, quotes over lines, open quotes, blank lines; small splits."""
    import csv
    import io

    bodies = ['a,b\n1,"x\ny"\r\n\n3,z\r4,"q""\r\n,"\n', 'é,b\n"ü\n\n",1', 'h\nv,"open\nto the end', 'h\nv,"open\nto the end\n', "n,m\n" + '17,"long, ""one""\nmore"\n' * 400]
    whole = {}
    for k, body in enumerate(bodies):
        for name, data in {"u": body.encode(), "m": b"\xef\xbb\xbf" + body.encode(), "w": body.encode("cp1252") + b"\n\x80", "l": b"\xef\xbb\xbf" + body.encode("latin-1") + b"\xe9\x81"}.items():
            (tmp_path / f"{name} {k}.csv").write_bytes(data)
            for encoding in ("utf-8-sig", "cp1252", "latin-1"):
                try:
                    text = data.decode(encoding)
                    break
                except UnicodeDecodeError:
                    continue
            whole[f"{name} {k}.csv"] = [(i, f, encoding) for i, f in enumerate(csv.reader(io.StringIO(text, newline="")), 1) if f]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    got = {}
    for r in D.records(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["row_no"], r["fields"], r["encoding"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: sorted(v) for k, v in got.items()} == whole
    # only as much of the lines is taken as the records given need
    import pyarrow as pa

    taken = []

    def batches():
        for k in range(20):
            taken.append(k)
            yield pa.RecordBatch.from_pydict({"file": pa.array([1] * 1000, pa.int32()), "kind": pa.array([0] * 1000, pa.int32()), "line": pa.array([b"x,y"] * 1000, pa.binary())})

    run = D.parser(",")(batches())
    assert next(run).num_rows == 5000 and len(taken) < 8 and 5000 + sum(b.num_rows for b in run) == 20_000


def test_positional_lists(spark, tmp_path):
    for name, text in {
        "sdn": '1,"ALPHA, Bo",individual,"X] [Y",' + "-0- ," * 7 + 'note\n2,BETA,-0- ,Z,' + "-0-," * 3 + '"12,300",' + ",".join(["-0-"] * 4) + "\nshort,row\n",
        "alt": "1,1,aka,Alfa,-0-\n1,2,aka,Alef,-0-\n9,3,aka,Lost,-0-\n", "add": '1,1,"5, Main St",Town,Land,-0-\n',
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(text)
    p = D.sdn(spark, str(tmp_path / "sdn"))
    full = {r["uid"]: r for r in D.with_side_files(p, spark, str(tmp_path / "alt"), str(tmp_path / "add")).collect()}
    assert full["SDN:1"]["aliases"] == ["Alfa", "Alef"] and full["SDN:1"]["programs"] == ["X", "Y"]
    assert full["SDN:1"]["addresses"] == ["5, Main St, Town, Land"] and full["SDN:1"]["countries"] == ["Land"]
    assert full["SDN:2"]["party_type"] == "unknown" and full["SDN:2"]["aliases"] == []
    assert [r["native_id"] for r in D.orphan_aliases(p, spark, str(tmp_path / "alt")).collect()] == ["9"]
    assert not D.drift(spark, str(tmp_path / "sdn")).first()["drifted"]


def test_dedupe(spark):
    rows = [("u", 1, "A", ["x"], ["p"], ["DE"], ""), ("u", 2, "B", ["X", "y"], [], ["FR"], "r"), ("v", 3, "C", [], [], [], "")]
    df = spark.createDataFrame(rows, "uid string, ord int, name string, aliases array<string>, addresses array<string>, countries array<string>, remarks string")
    got = {r["uid"]: r for r in D.dedupe(df).collect()}
    assert got["u"]["name"] == "A" and got["u"]["aliases"] == ["x", "y"] and got["u"]["countries"] == ["DE", "FR"] and got["u"]["remarks"] == "r"


def test_gates(spark):
    def files(drop=None, error=None, at="2026-01-01 00:00:00"):
        return spark.createDataFrame([(c, 5, error if c == "DPL" else None, at) for c in S.EXPECTED if c != drop], "code string, parties int, error string, fetched_at string")

    S.check(files(), "2026-01-02 00:00:00")
    for bad, now, waive in ((files(drop="SDN"), "2026-01-02 00:00:00", True), (files(error="x"), "2026-01-02 00:00:00", True), (files(), "2026-02-02 00:00:00", False), (files(), "2025-12-02 00:00:00", True)):
        with pytest.raises(S.GateError):
            S.check(bad, now, waive)
    S.check(files(), "2026-02-02 00:00:00", allow_stale=True)


def test_worklist(spark):
    df = spark.createDataFrame([("2", "a|b\n<c>", "REVIEW"), ("1", "x", "BLOCKED"), ("3", "y", "CLEAR")], "ref string, name string, disposition string")
    lines = K.worklist(df).splitlines()
    assert lines[2].startswith("| 1 |") and "a\\|b &lt;c&gt;" in lines[3] and len(lines) == 4
    assert spark.range(1).select(K.escaped(F.lit("a\\[b]"))).first()[0] == "a\\\\\\[b\\]"


def test_headed_lists(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text('id,source,entity_number,type,name,alt_names,countries,license_policy\na,Entity List (EL) - Bureau of Industry and Security,7,Entity,"Alpha, Ltd",A; B,DE,denial\nb,Entity Lists,,Vessel,Beta,,,\nc,Entity List,,,,,,\n')
    parties, rejects = D.headed_list(spark, str(tmp_path / "c"))
    got = {r["uid"]: r for r in parties.collect()}
    assert set(got) == {"EL:7", "UNKNOWN:b"}
    assert got["EL:7"]["aliases"] == ["A", "B"] and got["EL:7"]["remarks"] == "license policy: denial" and got["EL:7"]["party_type"] == "entity"
    assert [r["row_no"] for r in rejects.collect()] == [4]
    assert [r["label"] for r in D.unknown_labels(spark, str(tmp_path / "c")).collect()] == ["Entity Lists"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("Name\tEffective_Date\n\t1/1/2020\nZed\t2/1/2024\n")
    orders, _ = D.headed_list(spark, str(tmp_path / "t"), "\t", code="DPL", ordinal_ids=True)
    assert [(r["uid"], r["begin"]) for r in orders.collect()] == [("DPL:2", "2/1/2024")]


def test_discriminators_addresses_and_refusal(spark, tmp_path):
    for name, text in {"c": "Name,Source,DOB,Vessel Flag,IDs\nAnn,SDN,1970; 1971,PA,p 1\n", "t": "Name\tStreet_Address\tCity\tState\tCountry\tPostal_Code\tAction\nZed\t1 A St\tTown\tTX\tUS\t7\tdenied\n", "n": "who,what\na,b\n", "r": "name,country\na\nb,DE,x\nc,FR\nd\ne\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(text)
    one = D.headed_list(spark, str(tmp_path / "c"))[0].first()
    assert one["uid"] == "SDN:row0" and one["ids"] == ["p 1", "DOB: 1970", "DOB: 1971", "vessel flag: PA"]
    order = D.headed_list(spark, str(tmp_path / "t"), "\t", code="DPL", ordinal_ids=True)[0].first()
    assert order["addresses"] == ["1 A St, Town, TX, 7, US"] and order["remarks"] == "denied"
    with pytest.raises(ValueError, match="no name column"):
        D.headed_list(spark, str(tmp_path / "n"))
    told = D.ragged_report(spark, str(tmp_path / "r")).first()
    assert told["ragged"] == 4 and told["first"] == "row 2: 1 of 2 fields; row 3: 3 of 2 fields; row 5: 1 of 2 fields"


def test_json_lines_manifest_and_offline_refresh(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n[1]\n{bad\n{"id": "y"}\n')
    rows, errors = S.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int")
    assert [tuple(r) for r in rows.orderBy("line").collect()] == [(1, "x", 1), (5, "y", None)]
    assert [tuple(r) for r in errors.orderBy("line").collect()] == [(3, "no object"), (4, "no JSON")]
    S.write_manifest({"total": 2, "é": []}, str(tmp_path / "m.json"))
    assert S.read_manifest(str(tmp_path / "m.json")) == {"total": 2, "é": []}
    files = spark.createDataFrame([("SDN", "h1", "2026-01-05 00:00:00"), ("DPL", "h2", "2026-01-05 00:00:00"), ("EL", "h3", "2999-01-05 00:00:00")], "code string, sha256 string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    prior = spark.createDataFrame([("SDN", "h1", "2025-12-01 00:00:00"), ("DPL", "other", "2025-12-01 00:00:00")], "code string, sha256 string, fetched_at string")
    got = {r["code"]: (r["fetched_at"][:10], r["warning"]) for r in S.refresh_offline(files, prior).collect()}
    assert got == {"SDN": ("2025-12-01", None), "DPL": ("2026-01-05", "no prior entry: the file's own time"), "EL": ("2999-01-05", "dated in the future")}
