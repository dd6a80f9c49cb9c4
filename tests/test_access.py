"""Credentials and policies."""

import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from groundwell import ConfigError, StoreError
from groundwell.operators import access, embed
from groundwell.sources import files


def token(claims, secret="s", alg="HS256"):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    head = f"{part({'alg': alg, 'typ': 'JWT'})}.{part(claims)}"
    return f"{head}.{base64.urlsafe_b64encode(hmac.new(secret.encode(), head.encode(), hashlib.sha256).digest()).rstrip(b'=').decode()}"


def test_tokens(spark):
    good = {"sub": "ann", "roles": ["hr", "x"], "permissions": ["p"], "exp": 1_000}
    rows = [
        (1, token(good)), (2, "Bearer " + token({"sub": "bob"})), (3, token(good, "other")), (4, token(good, alg="none")), (5, token({**good, "exp": 999})), (6, token({"roles": ["hr"]})),
        (7, None), (8, "a.b"), (9, token(good)[:-3] + "AAA"), (10, "!!.??.%%"), (11, token({**good, "exp": "soon"})), (12, token(good) + ".x"),
    ]
    out = access.by_jwt(spark.createDataFrame(rows, "id int, credential string"), "s", now=F.timestamp_seconds(F.lit(999)))
    got = {r.id: (r.identity, r.is_authenticated, r.roles, r.permissions) for r in out.collect()}
    assert got[1] == ("ann", True, ["hr", "x"], ["p"]) and got[2] == ("bob", True, [], [])
    assert all(got[i] == (None, False, [], []) for i in range(3, 13)) and "credential" not in out.columns
    long = "k" * 100
    assert access.by_jwt(spark.createDataFrame([(1, token(good, long))], "id int, credential string"), long, now=F.timestamp_seconds(F.lit(1))).first().identity == "ann"
    with pytest.raises(ConfigError):
        access.by_jwt(out, "")


def test_keys(spark):
    keys = spark.createDataFrame([(hashlib.sha256(b"k1").hexdigest(), "ann", ["hr"], None)], "key_hash string, identity string, roles array<string>, permissions array<string>")
    got = {r.id: (r.identity, r.roles) for r in access.by_api_key(spark.createDataFrame([(1, "k1"), (2, "k2"), (3, None)], "id int, credential string"), keys).collect()}
    assert got == {1: ("ann", ["hr"]), 2: (None, []), 3: (None, [])}


def test_policy_changes(spark):
    granted = spark.createDataFrame([("user", ["read"])], "role string, granted array<string>")
    rules = spark.createDataFrame([("doc", "read", [], ["read"])], "resource string, action string, roles array<string>, permissions array<string>")
    asked = spark.createDataFrame([(1, "doc", "read", ["user"], []), (2, "doc", "drop", ["user"], [])], "request_id int, resource string, action string, roles array<string>, permissions array<string>")
    allowed = lambda r, g: [x.allowed for x in access.check_access(asked, r, g).orderBy("request_id").collect()]
    assert allowed(rules, granted) == [True, False]
    assert allowed(rules, access.revoke(granted, "user", "read")) == [False, False]
    assert allowed(access.with_rule(rules, "doc", "drop", [], ["drop"]), access.grant(granted, "user", "drop")) == [True, True]
    assert allowed(access.with_rule(rules, "doc", "drop", [], ["*"]), granted) == [True, True]
    assert allowed(rules, access.without_role(access.grant(granted, "new", "x"), "user")) == [False, False]
    assert [r.allowed for r in access.allow_all(asked).collect()] == [True, True]
    with pytest.raises(ConfigError):
        access.revoke(granted, "nobody", "read")


def test_registries(spark, tmp_path):
    assert embed.embedder_of("none").version == "none"
    with pytest.raises(ConfigError):
        embed.embedder_of("other")
    with pytest.raises(StoreError):
        files.read_chunks(spark, str(tmp_path / "none"))
