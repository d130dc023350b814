"""Table schemas. Names are snake_case; `MANIFEST` and `*_JSON` follow the JSON of the outside world."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, LONG, BOOL, TIME = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
TEXT_MAP = T.MapType(TEXT, TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_REF = struct(name=TEXT, key=TEXT)
_OUTPUTS = T.ArrayType(struct(type=TEXT))
_AUTH_SPEC = struct(
    type=TEXT,
    basic=struct(username_secret_ref=_REF, password_secret_ref=_REF),
    bearer=struct(token_secret_ref=_REF),
    api_key=struct(header_name=TEXT, value_secret_ref=_REF),
)
_MCP = struct(
    protocol_version=TEXT,
    client_name=TEXT,
    client_version=TEXT,
    require_tools_capability=BOOL,
    min_tool_count=INT,
    required_tools=T.ArrayType(TEXT),
)
_STEP = struct(
    name=TEXT, url=TEXT, method=TEXT, headers=TEXT_MAP, body=TEXT, expected_status=INT, contains_text=TEXT
)
_SPEC = struct(
    url=TEXT,
    method=TEXT,
    headers=TEXT_MAP,
    auth=_AUTH_SPEC,
    body=TEXT,
    interval=INT,
    expected_status=INT,
    contains_text=TEXT,
    mcp=_MCP,
    journey=T.ArrayType(_STEP),
    outputs=_OUTPUTS,
)
_PROBE_AUTH = struct(
    type=TEXT,
    username_credential_id=TEXT,
    password_credential_id=TEXT,
    token_credential_id=TEXT,
    header_name=TEXT,
    value_credential_id=TEXT,
)
_RESPONSE = struct(seq=INT, stage=TEXT, status_code=INT, body=TEXT, error_kind=TEXT, error=TEXT)

CANARIES = struct(namespace=TEXT, name=TEXT, created_at=TIME, spec=_SPEC)
PROBES = struct(
    name=TEXT,
    url=TEXT,
    method=TEXT,
    headers=TEXT_MAP,
    auth=_PROBE_AUTH,
    body=TEXT,
    interval=INT,
    expected_status=INT,
    contains_text=TEXT,
    mcp=_MCP,
    journey=T.ArrayType(_STEP),
    outputs=_OUTPUTS,
    config_error=TEXT,
)
SECRETS = struct(namespace=TEXT, name=TEXT, data=TEXT_MAP)
#: Changes of declarations (`kind` canary) and secrets (`kind` secret): op is create, update or delete.
DECLARATION_EVENTS = struct(
    kind=TEXT, namespace=TEXT, name=TEXT, op=TEXT, at=TIME, seq=LONG, created_at=TIME, spec=_SPEC, data=TEXT_MAP
)
CREDENTIALS = struct(credential_id=TEXT, value=TEXT)
EXCHANGES = struct(
    cycle_id=TEXT,
    probe=TEXT,
    cycle_started_at=TIME,
    seq=INT,
    stage=TEXT,
    started_at=TIME,
    finished_at=TIME,
    status_code=INT,
    body=TEXT,
    error_kind=TEXT,
    error=TEXT,
)
CHECK_CYCLES = struct(
    cycle_id=TEXT,
    probe=TEXT,
    started_at=TIME,
    finished_at=TIME,
    duration_us=LONG,
    responses=T.ArrayType(_RESPONSE),
)
RESULTS = struct(
    name=TEXT,
    healthy=BOOL,
    status_code=INT,
    last_check_time=TIME,
    message=TEXT,
    url=TEXT,
    expected_status=INT,
)
STATUSES = struct(
    namespace=TEXT, name=TEXT, phase=TEXT, last_check_time=TIME, last_status=INT, message=TEXT
)

# The JSON shapes of the outside world.
_STEP_JSON = struct(
    name=TEXT, url=TEXT, method=TEXT, headers=TEXT_MAP, body=TEXT, expectedStatus=INT, containsText=TEXT
)
_MCP_JSON = struct(
    protocolVersion=TEXT,
    clientName=TEXT,
    clientVersion=TEXT,
    requireToolsCapability=BOOL,
    minToolCount=INT,
    requiredTools=T.ArrayType(TEXT),
)
_AUTH_JSON = struct(
    type=TEXT,
    basic=struct(usernameSecretRef=_REF, passwordSecretRef=_REF),
    bearer=struct(tokenSecretRef=_REF),
    apiKey=struct(headerName=TEXT, valueSecretRef=_REF),
)
MANIFEST = struct(
    metadata=struct(namespace=TEXT, name=TEXT, creationTimestamp=TIME),
    spec=struct(
        url=TEXT,
        method=TEXT,
        headers=TEXT_MAP,
        auth=_AUTH_JSON,
        body=TEXT,
        interval=INT,
        expectedStatus=INT,
        containsText=TEXT,
        mcp=_MCP_JSON,
        journey=T.ArrayType(_STEP_JSON),
        outputs=_OUTPUTS,
    ),
    status=struct(phase=TEXT, lastCheckTime=TIME, lastStatus=INT, message=TEXT),
)
PROBES_JSON = struct(
    name=TEXT,
    url=TEXT,
    method=TEXT,
    headers=TEXT_MAP,
    auth=struct(
        type=TEXT,
        usernameCredentialID=TEXT,
        passwordCredentialID=TEXT,
        tokenCredentialID=TEXT,
        headerName=TEXT,
        valueCredentialID=TEXT,
    ),
    body=TEXT,
    interval=INT,
    expectedStatus=INT,
    containsText=TEXT,
    mcp=_MCP_JSON,
    journey=T.ArrayType(_STEP_JSON),
    outputs=_OUTPUTS,
    configError=TEXT,
)
RESULTS_JSON = struct(
    name=TEXT,
    healthy=BOOL,
    statusCode=INT,
    lastCheckTime=TIME,
    message=TEXT,
    url=TEXT,
    expectedStatus=INT,
)
