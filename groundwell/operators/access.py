"""Who asks and what they may do: credentials to roles, and role rules checked for a DataFrame of requests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError


def check_access(requests: DataFrame, rules: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """``requests`` (request_id, resource, action, roles, permissions) with allowed.

    No rule denies; "*" among a rule's roles or permissions allows; else a listed role or permission of the caller, or
    a permission of one of the caller's roles, where the permission "*" grants all.
    """
    none = F.array().cast("array<string>")
    held = requests.select("request_id", F.explode("roles").alias("role")).join(role_permissions, "role")
    held = held.groupBy("request_id").agg(F.array_distinct(F.flatten(F.collect_list("granted"))).alias("_granted"))
    out = requests.join(rules.select("resource", "action", F.col("roles").alias("_roles"), F.col("permissions").alias("_permissions")), ["resource", "action"], "left").join(held, "request_id", "left")
    granted = F.coalesce("_granted", none)
    allowed = F.array_contains("_roles", "*") | F.array_contains("_permissions", "*") | F.arrays_overlap("_roles", F.coalesce("roles", none)) | F.arrays_overlap("_permissions", F.coalesce("permissions", none)) | F.arrays_overlap("_permissions", granted) | F.array_contains(granted, "*")
    return out.withColumn("allowed", F.col("_roles").isNotNull() & F.coalesce(allowed, F.lit(False))).drop("_roles", "_permissions", "_granted")


def allow_all(requests: DataFrame) -> DataFrame:
    return requests.withColumn("allowed", F.lit(True))


def with_role(granted: DataFrame, role: str, permissions: list[str]) -> DataFrame:
    """The role permissions with ``role`` defined anew."""
    if not role:
        raise ConfigError("a role needs a name")
    row = granted.sparkSession.createDataFrame([(role, list(permissions))], "role string, granted array<string>")
    return without_role(granted, role).unionByName(row)


def without_role(granted: DataFrame, role: str) -> DataFrame:
    return granted.where(~F.col("role").eqNullSafe(role))


def grant(granted: DataFrame, role: str, permission: str) -> DataFrame:
    """One more permission for a role, which is defined if it is not yet."""
    if granted.where(F.col("role") == role).isEmpty():
        return with_role(granted, role, [permission])
    return granted.withColumn("granted", F.when(F.col("role") == role, F.array_union("granted", F.array(F.lit(permission)))).otherwise(F.col("granted")))


def revoke(granted: DataFrame, role: str, permission: str) -> DataFrame:
    """One permission less for a role; an unknown role is an error."""
    if granted.where(F.col("role") == role).isEmpty():
        raise ConfigError(f"unknown role {role!r}")
    return granted.withColumn("granted", F.when(F.col("role") == role, F.array_remove("granted", permission)).otherwise(F.col("granted")))


def with_rule(rules: DataFrame, resource: str, action: str, roles: list[str], permissions: list[str] | None = None) -> DataFrame:
    """The rules with the one of (resource, action) set anew."""
    if not resource or not action:
        raise ConfigError("a rule needs a resource and an action")
    row = rules.sparkSession.createDataFrame([(resource, action, list(roles), list(permissions or []))], "resource string, action string, roles array<string>, permissions array<string>")
    return rules.where(~((F.col("resource") == resource) & (F.col("action") == action))).unionByName(row)


def _caller(requests: DataFrame, identity: Column, roles: Column, permissions: Column) -> DataFrame:
    """``requests`` without the credential, with identity, is_authenticated, roles, permissions; anonymous where identity is null."""
    none = F.array().cast("array<string>")
    known = identity.isNotNull()
    columns = {"identity": identity, "is_authenticated": known, "roles": F.when(known, F.coalesce(roles, none)).otherwise(none), "permissions": F.when(known, F.coalesce(permissions, none)).otherwise(none)}
    return requests.withColumns(columns)


def by_api_key(requests: DataFrame, keys: DataFrame, *, credential_col: str = "credential") -> DataFrame:
    """Callers by key: keys (key_hash: SHA-256 in hex, identity, roles, permissions), so that no table holds a key itself.

    An unknown or null credential is anonymous.
    """
    table = keys.select(F.col("key_hash").alias("_key"), F.coalesce("identity", "key_hash").alias("_identity"), F.col("roles").alias("_roles"), F.col("permissions").alias("_permissions"))
    out = requests.withColumn("_hash", F.sha2(F.col(credential_col), 256)).join(table, F.col("_hash") == F.col("_key"), "left")
    return _caller(out, F.col("_identity"), F.col("_roles"), F.col("_permissions")).drop("_hash", "_key", "_identity", "_roles", "_permissions", credential_col)


def _from_base64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.try_to_binary(F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, F.lit("=")), F.lit("base64"))


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC of a text in built-in functions: the two padded keys are made here, the hashes on the executors."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    digest = lambda data: F.unhex(F.sha2(data, 256))
    return digest(F.concat(outer, digest(F.concat(inner, message.cast("binary")))))


def by_jwt(requests: DataFrame, secret: str, *, now: Column | None = None, credential_col: str = "credential", identity_claim: str = "sub", roles_claim: str = "roles", permissions_claim: str = "permissions") -> DataFrame:
    """Callers by an HS256 token, with or without "Bearer " before it.

    Anonymous: no token, a malformed one, another algorithm, a wrong signature, no identity, or an ``exp`` that is reached.
    """
    if not secret:
        raise ConfigError("tokens need a secret")
    token = F.regexp_replace(credential_col, "^Bearer ", "")
    parts = F.split(token, r"\.", -1)
    claim = lambda body, name: F.get_json_object(body, f"$['{name}']")
    out = requests.withColumns({"_p": parts, "_head": _from_base64url(F.get(parts, 0)).cast("string"), "_body": _from_base64url(F.get(parts, 1)).cast("string")})
    signed = _from_base64url(F.get("_p", 2)) == hmac_sha256(secret, F.concat_ws(".", F.slice("_p", 1, 2)))
    at = F.unix_timestamp(now if now is not None else F.current_timestamp())
    expiry = claim(F.col("_body"), "exp")
    alive = expiry.isNull() | F.coalesce(at < expiry.try_cast("double"), F.lit(False))
    good = (F.size("_p") == 3) & F.coalesce(signed, F.lit(False)) & F.coalesce(claim(F.col("_head"), "alg") == "HS256", F.lit(False)) & alive
    identity = F.when(good, F.nullif(claim(F.col("_body"), identity_claim), F.lit("")))
    lists = [F.from_json(claim(F.col("_body"), name), "array<string>") for name in (roles_claim, permissions_claim)]
    return _caller(out, identity, *lists).drop("_p", "_head", "_body", credential_col)
