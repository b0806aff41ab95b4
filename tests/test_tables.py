"""CSV, parquet, output names, policies and jobs on small files."""

from __future__ import annotations

import json
from pathlib import Path, PurePosixPath

import pytest
from pyspark.sql import functions as F

from maskloom.operators import policy as P
from maskloom.operators.masking import mask_table
from maskloom.plans import jobs
from maskloom.session import scratch_root
from maskloom.sources import tables


def test_csv_in(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(b'\xef\xbb\xbfa,b,c\n"x ""q"" y","two\nlines",NA\n  z ,,n/a\n"",\xff,keep\n')
    df = tables.csv_scan(spark, str(path))
    assert df.columns == ["a", "b", "c"]
    assert [tuple(r) for r in df.collect()] == [('x "q" y', "two\nlines", None), ("  z ", None, None), (None, "�", "keep")]
    kept = tables.csv_scan(spark, str(path), na_tokens=())
    assert kept.first()["c"] == "NA"


def test_files_are_split_unless_a_quoted_value_has_a_line_break(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_bytes(b'\xef\xbb\xbfa,b\r\n"x, ""q""",1\r\n\r\n  y ,NA\r\n')
    broken.write_bytes(b'a,b\n"x\ny",1\n')
    assert not tables.has_quoted_breaks(spark, str(plain)) and tables.has_quoted_breaks(spark, str(broken))
    for multi_line in (None, False, True):
        df = tables.csv_scan(spark, str(plain), multi_line=multi_line)
        assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [('x, "q"', "1"), ("  y ", None)]
    assert tables.csv_scan(spark, str(broken)).first()["a"] == "x\ny"


def test_big_files_without_breaks_are_split(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("a,b\n" + "some text,1\n" * 200_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        df = tables.csv_scan(spark, str(path))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 200_000
        assert tables.csv_scan(spark, str(path), multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_repeated_and_blank_header_names(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b,a,,a\n1,2,3,4,5\n")
    df = tables.csv_scan(spark, str(path))
    assert df.columns == ["a", "b", "a.1", "Unnamed: 3", "a.2"] and tuple(df.first()) == ("1", "2", "3", "4", "5")


def test_files_whose_columns_are_ordered_otherwise_are_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.csv_scan(spark, str(tmp_path)).collect()


def test_short_and_long_rows(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b\n1\n1,2,3\n")
    with pytest.raises(Exception, match="surplus fields in .*in.csv: 1,2,3"):
        tables.csv_scan(spark, str(path)).select("a").collect()
    assert [tuple(r) for r in tables.csv_scan(spark, str(path), surplus="drop").collect()] == [("1", None), ("1", "2")]
    with pytest.raises(Exception):
        tables.csv_scan(spark, str(path), mode="FAILFAST").collect()
    path.write_text("a,b\n1\n3,4\n\"x,y\"\n")
    assert [tuple(r) for r in tables.csv_scan(spark, str(path)).collect()] == [("1", None), ("3", "4"), ("x,y", None)]
    path.write_text("a,b\n1,2,,4\n")
    with pytest.raises(Exception, match="surplus fields"):
        tables.csv_scan(spark, str(path)).count()


def test_names_that_differ_in_case_only(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Name,name\nx,y\n")
    df = tables.csv_scan(spark, str(path))
    assert df.columns == ["Name", "name.1"] and tuple(df.first()) == ("x", "y")


def test_other_order_with_repeated_names_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,x,x\n1,Ann,2,3\n")
    (tmp_path / "y.csv").write_text("name,id,x,x\nBob,2,3,4\n")
    with pytest.raises(ValueError, match="headers differ"):
        tables.csv_scan(spark, str(tmp_path))


def test_one_column_keeps_its_empty_rows(spark, tmp_path):
    rows, out = [("a",), (None,), ("",), ("b",)], str(tmp_path / "out")
    tables.csv_sink(spark.createDataFrame(rows, "v STRING").coalesce(1), out)
    assert [r.v for r in tables.csv_scan(spark, out).collect()] == ["a", None, None, "b"]


def test_files_of_one_name_and_a_column_called_like_the_output(spark, tmp_path):
    out = str(tmp_path / "out")
    for folder, word in (("p", "Ann"), ("q", "Bob")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.csv").write_text(f"name,output_name\n{word},{folder}\n")
    by = jobs.mask_csv(spark, str(tmp_path / "in" / "*"), {"name": "name"}, out)
    done = {r[by]: r["output_name"] for r in spark.read.csv(out, header=True).collect()}
    assert by == "output_name_" and done == {"p/x_ANON.csv": "p", "q/x_ANON.csv": "q"}


def test_csv_out(spark, tmp_path):
    rows = [(' "q", ', None, "x\ny"), ("", "007", "\\b")]
    out = str(tmp_path / "out")
    tables.csv_sink(spark.createDataFrame(rows, "a STRING, b STRING, c STRING").coalesce(1), out)
    text = next(Path(out).glob("*.csv")).read_text()
    assert text == 'a,b,c\n" ""q"", ",,"x\ny"\n,007,\\b\n'
    back = tables.csv_scan(spark, out, na_tokens=()).collect()
    assert [tuple(r) for r in back] == [(' "q", ', None, "x\ny"), (None, "007", "\\b")]


@pytest.mark.parametrize(
    "name", ["users.csv", "a/b/users.csv", "a.d/users", "x.tar.gz", ".hidden", ".hidden.csv", "my file+1.csv", "a/b.c/..x"]
)
def test_output_names(spark, name):
    path = PurePosixPath(name)
    expected = str(path.with_name(f"{path.stem}_ANON{path.suffix}"))
    assert spark.range(1).select(tables.anon_path(F.lit(name))).first()[0] == expected


def test_many_files_each_with_its_own_salt(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    names = ["file_a.csv", "file b+c.csv"]
    for name in names:
        (folder / name).write_text("when,amount,note\n01/01/2025,100,N/A\n")
    jobs.mask_csv(spark, str(folder), {"when": "date", "amount": "amount"}, out)
    done = tables.csv_scan(spark, out).collect()
    got = {r["output_name"]: (r["when"], r["amount"], r["note"]) for r in spark.read.csv(out, header=True).collect()}
    source = spark.createDataFrame([("01/01/2025", "100", None)], "when STRING, amount STRING, note STRING")
    for name in names:
        expected = tuple(mask_table(source, {"when": "date", "amount": "amount"}, name).first())
        assert got[name.replace(".csv", "_ANON.csv")] == expected
    assert len(done) == 2
    listed = {r.file_name: r for r in jobs.input_files(spark, str(folder)).collect()}
    assert {n: Path(r.output_path).name for n, r in listed.items()} == {n: n.replace(".csv", "_ANON.csv") for n in names}
    assert (listed["file_a.csv"].offset, listed["file_a.csv"].multiplier) == (210, 2.742)


def test_parquet_round_trip(spark, tmp_path, card_payments, card_policy):
    masked, path = mask_table(card_payments, card_policy, "test.csv"), str(tmp_path / "p")
    tables.parquet_sink(masked, path)
    back = tables.parquet_scan(spark, path)
    assert masked.exceptAll(back).isEmpty() and back.exceptAll(masked).isEmpty()
    assert tables.parquet_scan(spark, path, ["Amount"]).columns == ["Amount"]
    assert any(".zstd." in f.name for f in Path(path).iterdir())


TOML = """
[columns]
"Transaction Date" = "date"
Amount = "amount"
Description = {type = "description", category_column = "Category"}
"""
YAML = """
columns:
  customer_name: {type: name, confidence: 0.97}
  email: email
skipped:
  internal_code: {confidence: 0.41, reason: low_confidence}
"""


def test_policy_files(tmp_path):
    (tmp_path / "p.toml").write_text(TOML)
    assert P.read_policy_file(tmp_path / "p.toml") == [
        ("Transaction Date", "date", None, ()), ("Amount", "amount", None, ()), ("Description", "description", "Category", ()),
    ]
    for suffix in ("yaml", "yml"):
        path = tmp_path / f"p.{suffix}"
        path.write_text(YAML)
        assert P.read_policy_file(path) == [("customer_name", "name", None, ()), ("email", "email", None, ())]
    (tmp_path / "bad.toml").write_text("[other]\na = 1\n")
    with pytest.raises(KeyError):
        P.read_policy_file(tmp_path / "bad.toml")


def test_policy_documents(spark):
    doc = (
        '{"columns": {"b": "name", "a": {"type": "description", "category_column": "Cat"}, '
        '"c": {"type": "email", "confidence": 0.9, "category_column": "z"}}}'
    )
    got = P.policy_normalise(spark.createDataFrame([(1, doc)], "id INT, doc STRING"), "doc").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "b", "name", None), (1, 1, "a", "description", "Cat"), (1, 2, "c", "email", None),
    ]
    with pytest.raises(Exception, match="no columns"):
        P.policy_normalise(spark.createDataFrame([(1, "{}")], "id INT, doc STRING"), "doc").collect()


def test_policy_table_round_trip(spark, tmp_path):
    found = spark.createDataFrame(
        [(0, "customer_name", "name", 0.97, "detected"), (1, "code", None, 0.41, "skipped"), (2, "email", "email", 0.99, "detected")],
        "position INT, column STRING, type STRING, confidence DOUBLE, status STRING",
    )
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        P.policy_table_write(found, path, fmt)
        stored = spark.read.schema(P.POLICY_SCHEMA).format(fmt).load(path).orderBy("position").collect()
        assert [(r.status, r.reason, r.field_type) for r in stored] == [
            ("detected", None, "name"), ("skipped", "low_confidence", None), ("detected", None, "email"),
        ]
        assert P.policy_entries(P.policy_table_read(spark, path, fmt)) == [
            ("customer_name", "name", None, ()), ("email", "email", None, ()),
        ]


DETECTED_RULES = {
    '{"type": "amount", "confidence": 0.9, "category_column": "x"}': ("amount", None),
    '{"type": "description", "confidence": null, "category_column": "x"}': ("description", None),
    '{"type": "description", "confidence": 0.9, "category_column": "x"}': ("description", None),
    '{"type": "description", "category_column": "x"}': ("description", "x"),
    '"name"': ("name", None),
}


def test_both_readers_of_a_policy_agree(spark, tmp_path):
    for rule, want in DETECTED_RULES.items():
        document = '{"columns": {"a": %s}}' % rule
        (tmp_path / "p.json").write_text(document)
        [entry] = P.read_policy_file(tmp_path / "p.json")
        [row] = P.policy_normalise(spark.createDataFrame([(document,)], "doc STRING"), "doc").collect()
        assert (entry.field_type, entry.category_column) == (row.field_type, row.category_column) == want


def test_a_proposal_is_a_file_to_edit(spark, tmp_path):
    found = spark.createDataFrame(
        [
            (0, "wer", "name", 0.97, None, "detected"), (1, "code", None, 0.41, None, "skipped"),
            (2, "tag", "date", 1.0, "yyyy-MM-dd; dd.MM.yyyy", "detected"),
        ],
        "position INT, column STRING, type STRING, confidence DOUBLE, formats STRING, status STRING",
    )
    for suffix in ("yaml", "json"):
        path = tmp_path / f"p.{suffix}"
        P.policy_file_write(found, path)
        assert P.read_policy_file(path) == [("wer", "name", None, ()), ("tag", "date", None, ("yyyy-MM-dd", "dd.MM.yyyy"))]
        assert json.loads(path.read_text())["skipped"] == {"code": {"confidence": 0.41, "reason": "low_confidence"}}
    with pytest.raises(ValueError, match="ends in"):
        P.policy_file_write(found, tmp_path / "p.toml")
    with pytest.raises(ValueError, match="formats"):
        P.as_entries([("a", "name", None, ("yyyy-MM-dd",))])


def test_a_stored_policy_carries_date_patterns(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-{i % 12 + 1:02d}-11") for i in range(600)], "k INT, day STRING")
    jobs.propose_policy(spark, df, str(tmp_path / "policy"), row_key="k")
    jobs.mask_with_stored_policy(spark, df, str(tmp_path / "policy"), "days.csv", str(tmp_path / "out"))
    masked = spark.read.parquet(str(tmp_path / "out"))
    assert masked.join(df, ["k", "day"]).count() == 0
    assert masked.where("day rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").count() == 600


def test_policy_checks():
    with pytest.raises(ValueError, match="twice"):
        P.as_entries([("a", "name"), ("a", "email")])
    with pytest.raises(ValueError):
        P.as_entries([("a", "name", "Category")])


def test_detect_and_mask_job(spark, tmp_path):
    from maskloom.operators.generate import gen_sample

    df, stored, out = gen_sample(spark, 600), str(tmp_path / "policy"), str(tmp_path / "out")
    assert jobs.propose_policy(spark, df, stored).where("status = 'detected'").count() == 7
    report = jobs.mask_with_stored_policy(spark, df, stored, "sample.csv", out)
    assert report == {"columns_masked": 7, "rows_processed": 600}
    assert spark.read.parquet(out).columns == df.columns


class FakeSession:
    """Stands for a cluster session: the setting is fixed at start and cannot be changed here."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": "yarn", "applicationId": "app"})


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(FakeSession("hdfs://shared/folder")) == "hdfs://shared/folder"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(FakeSession(None))
    assert Path(scratch_root(spark)).is_dir()
