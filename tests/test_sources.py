"""Readers and sinks."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException

from helpers import result, results, seconds
from probelens import session
from probelens.sources import readers, sinks

MANIFEST = {
    "apiVersion": "v1alpha1",
    "kind": "HttpCanary",
    "metadata": {"name": "sample", "namespace": "default", "creationTimestamp": "2024-01-01T00:00:00Z"},
    "spec": {
        "url": "https://x.test",
        "expectedStatus": 204,
        "auth": {"type": "apiKey", "apiKey": {"headerName": "X", "valueSecretRef": {"name": "s", "key": "k"}}},
        "mcp": {"minToolCount": 2, "requiredTools": ["a"]},
        "journey": [{"name": "one", "url": "https://x.test/1", "containsText": "t"}],
        "outputs": [{"type": "stdout"}],
    },
    "status": {"phase": "Healthy", "lastStatus": 204},
}


def write(folder, name, *documents) -> str:
    path = folder / name
    path.write_text("\n".join(json.dumps(d) for d in documents))
    return str(path)


def test_read_manifests(spark, tmp_path):
    path = write(tmp_path, "canaries.json", MANIFEST, {"metadata": {"name": "b", "namespace": "n"}, "spec": {"url": "u"}})
    row, bare = readers.read_canaries(spark, path).orderBy("namespace").collect()
    assert (row.namespace, row.name, row.created_at) == ("default", "sample", dt.datetime(2024, 1, 1))
    assert row.spec.expected_status == 204 and row.spec.method is None and row.spec.journey[0].contains_text == "t"
    assert row.spec.auth.api_key.value_secret_ref.name == "s" and row.spec.mcp.required_tools == ["a"]
    assert bare.spec.auth is None and bare.spec.url == "u"
    first, second = readers.read_statuses(spark, path).orderBy("namespace").collect()
    assert (first.phase, first.last_status, first.message, second.phase) == ("Healthy", 204, None, None)


def test_read_probes_applies_no_defaults(spark, tmp_path):
    path = write(tmp_path, "probes.json", {"name": "a/b", "url": "u", "auth": {"type": "bearer", "tokenCredentialID": "t"}})
    row = readers.read_probes(spark, path).collect()[0]
    assert (row.expected_status, row.interval, row.method, row.mcp) == (0, 0, None, None)
    assert row.auth.token_credential_id == "t" and row.auth.username_credential_id is None


def test_read_credentials(spark, tmp_path):
    path = write(tmp_path, "credentials.json", {"credential_id": "a", "value": "v"})
    assert [tuple(r) for r in readers.read_credentials(spark, path).collect()] == [("a", "v")]
    with pytest.raises(AnalysisException):
        readers.read_credentials(spark, str(tmp_path / "absent.json"))
    assert readers.read_credentials(spark, None).isEmpty()


TRUNCATED = [
    (readers.read_probes, '{"name":"a","interval":30}\n{"name":"b","inter'),
    (readers.read_probes, '{"interval":30}'),
    (readers.read_canaries, '{"metadata":{"namespace":"n","name":"a"},"spec":{"url":"u"}}\n{"metadata":{"name'),
    (readers.read_credentials, '{"credential_id":"a","value":"b"}\n{"credential_id'),
    (readers.read_credentials, '{"value":"b"}'),
    (readers.read_results, '[{"name":"a"'),
]


@pytest.mark.parametrize("case", range(len(TRUNCATED)))
def test_what_does_not_decode_is_an_error(spark, tmp_path, case):
    read, text = TRUNCATED[case]
    path = tmp_path / "broken.json"
    path.write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|no name|no credential_id|no namespace|cannot be parsed|parse|FAILED_READ_FILE"):
        read(spark, str(path)).collect()


def test_a_poll_that_does_not_decode_is_an_error(spark):
    for body in ('[{"name":"a"', "<html>"):
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            readers.results_from_text(spark.createDataFrame([(body,)], "body string"), "body").collect()


def test_results_round_trip(spark, tmp_path):
    log = results(
        spark,
        result("a", message='Response body did not contain "<b>&"', at=seconds(1), to_lines=True),
        result("b", False, 0, at=seconds(2) + dt.timedelta(microseconds=120), to_lines=True, to_metrics=False),
        result("c"),
    )
    lines = [r.value for r in sinks.result_lines(log).orderBy("value").collect()]
    assert lines[0] == (
        '{"name":"a","healthy":true,"statusCode":200,"lastCheckTime":"2024-01-01T00:00:01Z",'
        '"message":"Response body did not contain \\"\\u003cb\\u003e\\u0026\\"","url":"https://x.test","expectedStatus":200}'
    )
    assert '"lastCheckTime":"2024-01-01T00:00:02.00012Z"' in lines[1] and len(lines) == 2
    sinks.write_result_lines(log, str(tmp_path / "lines"))
    back = readers.read_results(spark, str(tmp_path / "lines"), lines=True).orderBy("name").collect()
    assert back[0].message == 'Response body did not contain "<b>&"' and back[1].last_check_time == seconds(2) + dt.timedelta(microseconds=120)

    (tmp_path / "arrays").mkdir()
    (tmp_path / "arrays" / "one.json").write_text("[" + ",\n".join(lines) + "]")
    (tmp_path / "arrays" / "two.json").write_text("[]")
    assert readers.read_results(spark, str(tmp_path / "arrays")).orderBy("name").collect() == back
    bodies = spark.createDataFrame([(1, "[" + ",".join(lines) + "]"), (2, "[]")], "poll int, body string")
    parsed = readers.results_from_text(bodies, "body")
    assert parsed.columns[0] == "poll" and [r.name for r in parsed.orderBy("name").collect()] == ["a", "b"]


def test_snapshot_has_every_probe(spark):
    rows = sinks.results_snapshot(results(spark, result("a"), result("b", to_metrics=False))).collect()
    assert sorted(json.loads(r.value)["name"] for r in rows) == ["a", "b"]


def test_status_versions_replace_each_other(spark, tmp_path):
    row = spark.createDataFrame([("n", "a", "Healthy")], "namespace string, name string, phase string")
    for _ in range(2):
        sinks.write_statuses(row, str(tmp_path / "s"), version=3)
        sinks.write_status_changes(row, str(tmp_path / "c"), version=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1 and spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == folder and session.run_dir(spark, "x").startswith(folder + "/x-")
