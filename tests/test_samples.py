"""The sample declarations end to end: manifest, probe, recorded responses, result, status, listing."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from helpers import cycle, cycles, response, seconds, table
from probelens import schemas
from probelens.operators import auth, evaluate, specs, status
from probelens.sources import readers

OK_INIT = '{"result":{"protocolVersion":"2025-11-25","capabilities":{"tools":{}}}}'
OK_TOOLS = '{"result":{"tools":[{"name":"health.check"}]}}'


def manifest(name, **spec):
    meta = {"name": name, "namespace": "default", "creationTimestamp": "2024-01-01T00:00:00Z"}
    return {"metadata": meta, "spec": {"interval": 30, **spec}}


def one(name, text):
    return {"name": name, "url": f"https://x.test/{name}", "expectedStatus": 200, "containsText": text}


SAMPLES = [
    (manifest("http-check", url="https://x.test/200", expectedStatus=200), [response()], "Healthy"),
    (manifest("http-check-204", url="https://x.test/204", expectedStatus=204), [response(status=204)], "Healthy"),
    (manifest("http-check-unhealthy", url="https://x.test/503"), [response(status=503)], "Unhealthy"),
    (manifest("api-readiness", url="https://x.test/204", expectedStatus=204), [response(status=204)], "Healthy"),
    (
        manifest("ui-login", url="https://x.test/c", containsText="demo", journey=[one("set", "demo"), one("verify", "demo")]),
        [response(0, body="session demo"), response(1, body="demo")],
        "Healthy",
    ),
    (
        manifest("checkout", url="https://x.test/c", journey=[one("cart", "plan"), one("checkout", "/checkout")]),
        [response(0, body='{"plan":1}'), response(1, body="/anything/checkout")],
        "Healthy",
    ),
    (
        manifest(
            "mcp-tools",
            url="https://tools.test",
            auth={"type": "bearer", "bearer": {"tokenSecretRef": {"name": "s", "key": "token"}}},
            mcp={"minToolCount": 1, "requiredTools": ["health.check"]},
            outputs=[{"type": "prometheus"}, {"type": "stdout"}],
        ),
        [response(0, body=OK_INIT), response(1, 202), response(2, body=OK_TOOLS)],
        "Healthy",
    ),
    (
        manifest("no-secret", url="https://x.test", auth={"type": "bearer", "bearer": {"tokenSecretRef": {"name": "x", "key": "token"}}}),
        [],
        "Unhealthy",
    ),
]


def test_samples_reach_their_phase(spark, tmp_path):
    path = tmp_path / "samples.json"
    path.write_text("\n".join(json.dumps(m) for m, *_ in SAMPLES))
    declared = specs.spec_defaults(readers.read_canaries(spark, str(path)))
    assert specs.rejected_canaries(declared).isEmpty()
    secrets = table(spark, schemas.SECRETS, {"namespace": "default", "name": "s", "data": {"token": "fake"}})
    probe_table = auth.probes_with_auth(declared, secrets)
    log = cycles(spark, *[cycle(m["metadata"]["name"], f"default/{m['metadata']['name']}", *rs) for m, rs, _ in SAMPLES])
    results = evaluate.check_results(log, probe_table)
    before = readers.read_statuses(spark, str(path))
    merged = status.status_merge(before, status.latest_results(results))
    listed = status.canary_listing(declared, merged, F.lit(seconds(60)))
    assert {r.name: r.phase for r in listed.collect()} == {m["metadata"]["name"]: phase for m, _, phase in SAMPLES}
    broken = results.where("mode = 'config_error'").collect()
    assert [r.message for r in broken] == ['Invalid auth config: resolving bearer token: secrets "x" not found']
