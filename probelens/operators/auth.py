"""Credential references of declarations, resolved against secrets by join.

Secret values stay in the `secrets` table: resolution reads key names only, and `credential_store` gives
values just on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.functions.text import is_blank, quoted, text_or_empty
from probelens.operators.joins import lookup_join
from probelens.operators.specs import probe_set

# Per role the label in messages and the last part of the credential id.
ROLES = {
    "username": ("basic username", "basic-username"),
    "password": ("basic password", "basic-password"),
    "token": ("bearer token", "bearer-token"),
    "value": ("apiKey value", "api-key"),
}
INVALID = "Invalid auth config: "


def credential_id(namespace: Column, name: Column, role: str) -> Column:
    return F.concat_ws("__", namespace, name, F.lit(ROLES[role][1]))


def _references() -> Column:
    """The references a declaration needs, in the order they are looked up; empty for a broken block."""
    auth = F.col("spec.auth")

    def ref(order: int, role: str, secret_ref: Column) -> Column:
        return F.struct(
            F.lit(order).alias("ord"),
            F.lit(role).alias("role"),
            secret_ref["name"].alias("secret_name"),
            secret_ref["key"].alias("key"),
            credential_id(F.col("namespace"), F.col("name"), role).alias("credential_id"),
        )

    return (
        F.when(
            (auth["type"] == "basic") & auth["basic"].isNotNull(),
            F.array(
                ref(0, "username", auth["basic"]["username_secret_ref"]),
                ref(1, "password", auth["basic"]["password_secret_ref"]),
            ),
        )
        .when(
            (auth["type"] == "bearer") & auth["bearer"].isNotNull(),
            F.array(ref(0, "token", auth["bearer"]["token_secret_ref"])),
        )
        .when(
            (auth["type"] == "apiKey") & ~is_blank(auth["api_key"]["header_name"]),
            F.array(ref(0, "value", auth["api_key"]["value_secret_ref"])),
        )
    )


def auth_references(canaries: DataFrame) -> DataFrame:
    """One row per secret key a declaration needs."""
    refs = canaries.select("namespace", "name", F.explode(_references()).alias("r"))
    return refs.select("namespace", "name", "r.*")


def _block_error() -> Column:
    """Error of the auth block itself, found before any secret is read; null when sound or absent."""
    auth = F.col("spec.auth")
    kind = text_or_empty(auth["type"])
    missing = {
        "basic": (auth["basic"].isNull(), "basic auth requires the basic block"),
        "bearer": (auth["bearer"].isNull(), "bearer auth requires the bearer block"),
        "apiKey": (auth["api_key"].isNull(), "apiKey auth requires the apiKey block"),
    }
    error = F.when(auth.isNull(), F.lit(None).cast("string"))
    for name, (test, text) in missing.items():
        error = error.when((kind == name) & test, F.lit(text))
    return error.when(
        (kind == "apiKey") & is_blank(auth["api_key"]["header_name"]), F.lit("apiKey auth requires headerName")
    ).when(~kind.isin(*missing), F.concat(F.lit("unsupported auth type "), quoted(kind)))


def _reference_error(ref: Column, found: Column, keys: Column) -> Column:
    """Error of one reference, given whether its secret exists and the key names in it."""
    reason = (
        F.when(is_blank(ref["secret_name"]), F.lit("secret name is required"))
        .when(is_blank(ref["key"]), F.lit("secret key is required"))
        .when(found.isNull(), F.format_string('secrets "%s" not found', ref["secret_name"]))
        .when(
            ~F.array_contains(keys, ref["key"]),
            F.concat(
                F.lit("secret "),
                F.concat_ws("/", F.col("namespace"), ref["secret_name"]),
                F.lit(" is missing key "),
                quoted(ref["key"]),
            ),
        )
    )
    label = F.lit(None).cast("string")
    for role, (text, _) in ROLES.items():
        label = F.when(ref["role"] == role, F.lit(text)).otherwise(label)
    return F.when(ref.isNotNull(), F.concat(F.lit("resolving "), label, F.lit(": "), reason))


def resolve_auth(canaries: DataFrame, secrets: DataFrame) -> DataFrame:
    """Add `auth` (credential ids) and `config_error`; of the two, at most one is set.

    A declaration needs two references at most, so they are looked up as two columns of its row: no
    explode, no grouping back. Each lookup spreads a secret shared by very many declarations.
    """
    refs = _references()
    index = secrets.select(
        F.col("namespace"), F.col("name").alias("_secret"), F.map_keys("data").alias("_keys"), F.lit(True).alias("_is")
    )
    found = canaries.withColumns({"_ref0": F.get(refs, F.lit(0)), "_ref1": F.get(refs, F.lit(1))})
    for i in (0, 1):
        side = index.withColumnsRenamed({"_keys": f"_keys{i}", "_is": f"_is{i}"})
        found = lookup_join(
            found.withColumn("_secret", F.col(f"_ref{i}.secret_name")),
            side,
            on=["namespace", "_secret"],
            spread_by=["name"],
            how="left",
        ).drop("_secret")
    error = F.coalesce(
        _block_error(),
        _reference_error(F.col("_ref0"), F.col("_is0"), F.col("_keys0")),
        _reference_error(F.col("_ref1"), F.col("_is1"), F.col("_keys1")),
    )
    kind = F.col("spec.auth.type")

    def id_of(wanted: str, position: int) -> Column:
        return F.when(kind == wanted, F.col(f"_ref{position}.credential_id"))

    auth = F.struct(
        kind.alias("type"),
        id_of("basic", 0).alias("username_credential_id"),
        id_of("basic", 1).alias("password_credential_id"),
        id_of("bearer", 0).alias("token_credential_id"),
        F.when(kind == "apiKey", F.col("spec.auth.api_key.header_name")).alias("header_name"),
        id_of("apiKey", 0).alias("value_credential_id"),
    )
    resolved = found.withColumn("_error", error)
    return resolved.select(
        *canaries.columns,
        F.when(F.col("spec.auth").isNotNull() & F.col("_error").isNull(), auth).alias("auth"),
        F.concat(F.lit(INVALID), F.col("_error")).alias("config_error"),
    )


def probes_with_auth(canaries: DataFrame, secrets: DataFrame) -> DataFrame:
    """The probe set of declarations with `auth` and `config_error`, ready for evaluation."""
    return probe_set(resolve_auth(canaries, secrets))


def credential_store(canaries: DataFrame, secrets: DataFrame, with_values: bool = False) -> DataFrame:
    """Credentials of the declarations whose auth resolves; the last declaration wins an id.

    Gives ids and a presence flag; `with_values` adds the secret value.
    """
    valid = resolve_auth(canaries, secrets).where(F.col("auth").isNotNull())
    refs = auth_references(valid)
    held = secrets.select("namespace", F.col("name").alias("secret_name"), "data")
    found = lookup_join(refs, held, on=["namespace", "secret_name"], spread_by=["name"], how="inner")
    order = F.struct("namespace", "name")
    value = [F.max_by(F.col("data")[F.col("key")], order).alias("value")] if with_values else []
    return found.groupBy("credential_id").agg(F.lit(True).alias("value_present"), *value)


def runtime_auth_errors(probes: DataFrame, credentials: DataFrame) -> DataFrame:
    """Probes whose request would fail for auth, with the error of the first failing credential.

    One lookup serves all credentials: a probe is one row per credential it needs, and only failing rows
    are grouped again.
    """
    auth = F.col("auth")
    kind = text_or_empty(auth["type"])

    def needed(order: int, held: Column, error: Column | None = None) -> Column:
        text = F.lit(None).cast("string") if error is None else error
        return F.struct(F.lit(order).alias("ord"), held.alias("credential_id"), text.alias("error"))

    def unusable(error: Column) -> Column:
        return F.array(needed(0, F.lit(None).cast("string"), error))

    rows = (
        F.when(
            kind == "basic",
            F.array(needed(0, auth["username_credential_id"]), needed(1, auth["password_credential_id"])),
        )
        .when(kind == "bearer", F.array(needed(0, auth["token_credential_id"])))
        .when(
            (kind == "apiKey") & is_blank(auth["header_name"]), unusable(F.lit("apiKey auth is missing headerName"))
        )
        .when(kind == "apiKey", F.array(needed(0, auth["value_credential_id"])))
        .otherwise(unusable(F.concat(F.lit("unsupported auth type "), quoted(kind))))
    )
    wanted = probes.where(auth.isNotNull()).select("name", auth["type"].alias("auth_type"), F.inline(rows))
    held = credentials.select("credential_id", F.lit(True).alias("_held"))
    found = lookup_join(wanted, held, on=["credential_id"], spread_by=["name"], how="left")
    identifier = F.col("credential_id")
    error = F.coalesce(
        F.col("error"),
        F.when(is_blank(identifier), F.lit("missing credential reference")),
        F.when(F.col("_held").isNull(), F.concat(F.lit("missing credential "), quoted(identifier))),
    )
    failing = found.withColumn("error", error).where("error IS NOT NULL")
    return failing.groupBy("name", "auth_type").agg(F.min_by("error", "ord").alias("error"))
