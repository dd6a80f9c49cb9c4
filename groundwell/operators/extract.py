"""Structured extraction: schemas, prompts, parsing, validation, merging of turns, evidence, status, routing."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigError, EngineError
from .guard import injection_reason
from .mask import mask

# Keys that a context summary looks for.
SUMMARY_KEYS = ("errorcode", "error_code", "code", "status", "statuscode", "status_code", "responsecode", "response_code", "message", "error", "reason", "detail", "exception", "result", "resultcode")
SUMMARY_LENGTH = 600
CONTEXT_LIMIT = 500_000
STATUSES = ("BLOCKED", "FAILED", "INVALID", "NEEDS_CLARIFICATION", "COMPLETE")
TYPES = {"str": str, "int": int, "float": float, "bool": bool}


@dataclass(frozen=True)
class Field:
    """kind: str, int, float, bool, a tuple of Fields (object) or a one-element list of a kind."""

    name: str
    kind: object = "str"
    required: bool = True
    description: str = ""


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, name: str, spec) -> Schema:
        """From a list of names (required strings) or a dict of name to kind or (kind, description); nested dicts and [item] allowed."""
        if isinstance(spec, (list, tuple)):
            return cls(name, tuple(Field(n) for n in spec))
        return cls(name, tuple(_field(n, k) for n, k in spec.items()))

    def ddl(self) -> str:
        """The Spark type of valid data."""
        return "struct<" + ",".join(f"`{f.name}`:{_ddl(f.kind)}" for f in self.fields) + ">"


def _field(name: str, kind) -> Field:
    description = ""
    if isinstance(kind, tuple) and len(kind) == 2 and isinstance(kind[1], str):
        kind, description = kind
    optional = isinstance(kind, str) and kind.endswith("?")
    kind = kind.rstrip("?") if isinstance(kind, str) else kind
    if isinstance(kind, dict):
        kind = Schema.of(name, kind).fields
    elif isinstance(kind, list) and kind and isinstance(kind[0], dict):
        kind = [Schema.of(name, kind[0]).fields]
    return Field(name, kind, not optional, description)


def _ddl(kind) -> str:
    if isinstance(kind, list):
        return f"array<{_ddl(kind[0])}>"
    if isinstance(kind, tuple):
        return "struct<" + ",".join(f"`{f.name}`:{_ddl(f.kind)}" for f in kind) + ">"
    return {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}[kind]


def parse_object(reply: str | None) -> dict | None:
    """The JSON object of a reply: without a code fence, whole, else from the first { to the last }."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", reply or "").strip()
    for candidate in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def pointer(path: tuple) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)


def validate(data: dict, fields: tuple[Field, ...], path: tuple = ()) -> tuple[dict, list[dict]]:
    """(coerced data, issues): a missing or null required field asks for clarification, a wrong value is invalid."""
    out, issues = {}, []
    for f in fields:
        value, at = data.get(f.name), (*path, f.name)
        if value is None:
            out[f.name] = None
            if f.required:
                issues.append({"kind": "NEEDS_CLARIFICATION", "code": "missing", "path": pointer(at)})
            continue
        out[f.name], found = _coerce(value, f.kind, at)
        issues += found
    return out, issues


def _coerce(value, kind, path):
    wrong = None, [{"kind": "INVALID", "code": "type", "path": pointer(path)}]
    if isinstance(kind, tuple):
        return validate(value, kind, path) if isinstance(value, dict) else wrong
    if isinstance(kind, list):
        if not isinstance(value, list):
            return wrong
        pairs = [_coerce(v, kind[0], (*path, i)) for i, v in enumerate(value)]
        return [p[0] for p in pairs], [x for p in pairs for x in p[1]]
    if kind == "bool":
        named = {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False, "on": True, "off": False}
        found = value if isinstance(value, bool) else named.get(str(value).strip().lower())
        return (found, []) if found is not None else wrong
    if kind == "str":
        return (value, []) if isinstance(value, str) else wrong
    try:
        number = float(value) if not isinstance(value, bool) else float(int(value))
        return (number, []) if kind == "float" else (int(number), []) if number == int(number) else wrong
    except (TypeError, ValueError, OverflowError):
        return wrong


def deep_merge(earlier, current):
    """The current value over the earlier one: null and the empty list keep the earlier, objects merge by key."""
    if current is None or (isinstance(current, list) and not current and earlier is not None):
        return earlier
    if isinstance(earlier, dict) and isinstance(current, dict):
        return {k: deep_merge(earlier.get(k), current.get(k)) for k in [*earlier, *(k for k in current if k not in earlier)]}
    return current


def drop_invalid(prior, fields: tuple[Field, ...]):
    """Earlier data with every value that no longer fits the schema set to null; what is missing stays missing."""
    if not isinstance(prior, dict):
        return None
    known = {f.name: f for f in fields}
    return {name: _cleared(value, known[name].kind) for name, value in prior.items() if name in known}


def _cleared(value, kind):
    if value is None:
        return None
    if isinstance(kind, tuple):
        return drop_invalid(value, kind)
    if isinstance(kind, list):
        return [_cleared(v, kind[0]) for v in value] if isinstance(value, list) else None
    coerced, issues = _coerce(value, kind, ())
    return None if issues else coerced


def leaves(value, path: tuple = ()):
    """(path, value) of every scalar."""
    if isinstance(value, dict):
        for name, item in value.items():
            yield from leaves(item, (*path, name))
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from leaves(item, (*path, i))
    else:
        yield path, value


def lookup(value, path: tuple, absent=None):
    for part in path:
        try:
            value = value[part]
        except (KeyError, IndexError, TypeError):
            return absent
    return value


def plain(text) -> str:
    """Normal form KC, case folded, all four i's one letter, white space collapsed."""
    folded = unicodedata.normalize("NFKC", str(text)).casefold()
    return re.sub(r"\s+", " ", folded.translate({0x307: None, 0x131: "i"})).strip()


def number_forms(value: float) -> set[str]:
    """Ways to write a number: plain, grouped by comma, point or space, with a decimal point or comma."""
    sign, size = ("-" if value < 0 else ""), abs(value)
    exact = float(size).is_integer()
    whole, part = (str(int(size)), "") if exact else repr(float(size)).split(".", 1) if "." in repr(float(size)) else (repr(float(size)), "")
    by_comma = f"{int(whole):,}" if whole.isdigit() else whole
    styles = {"": ".,", ",": ".", ".": ",", " ": ","}  # what separates thousands, and the decimal marks that go with it
    return {sign + by_comma.replace(",", group) + (mark + part if part else "") for group, marks in styles.items() for mark in marks}


def evidence(value, quote: str | None, source: str, prior=None) -> str:
    """SOURCE, PRIOR, MISMATCH, UNGROUNDED or MISSING for one scalar value.

    A number counts where no digit stands next to it, so 5 is found in "1,5" too: a known weakness that is kept.
    """
    if value is None:
        return "MISSING"
    plain_quote = plain(quote or "")
    real = bool(plain_quote) and plain_quote in plain(source)
    if isinstance(value, bool):
        held = real
    elif isinstance(value, (int, float)):
        held = real and any(re.search(rf"(?<!\d){re.escape(f)}(?!\d)", plain_quote) for f in number_forms(value))
    else:
        held = real and plain(value) in plain_quote
    if held:
        return "SOURCE"
    if prior is not None and prior == value:
        return "PRIOR"
    return "MISMATCH" if real else "UNGROUNDED"


def status(issues: Column, blocked: Column, failed: Column) -> Column:
    """BLOCKED over FAILED over INVALID over NEEDS_CLARIFICATION over COMPLETE."""
    has = lambda kind: F.exists(issues, lambda i: i["kind"] == kind)
    return F.when(blocked, "BLOCKED").when(failed, "FAILED").when(has("INVALID"), "INVALID").when(has("NEEDS_CLARIFICATION"), "NEEDS_CLARIFICATION").otherwise("COMPLETE")


def clarification(schema: Schema, issues: Column) -> Column:
    """A question that names the missing fields by description or name, each once, in order."""
    labels = F.create_map(*(F.lit(x) for f in schema.fields for x in ("/" + f.name, f.description or f.name)))
    missing = F.transform(F.filter(issues, lambda i: i["kind"] == "NEEDS_CLARIFICATION"), lambda i: F.coalesce(F.try_element_at(labels, i["path"]), i["path"]))
    return F.when(F.size(missing) > 0, F.concat(F.lit("Please provide: "), F.array_join(F.array_distinct(missing), ", "), F.lit(".")))


ISSUES = "array<struct<kind:string,code:string,path:string>>"


FIELDS = "map<string,struct<provenance:string,quote:string>>"


@dataclass(frozen=True)
class Rule:
    """A caller's rule: rows where ``broken`` holds get an issue of a kind, INVALID or NEEDS_CLARIFICATION, at a path."""

    broken: Column
    kind: str
    code: str
    path: str = ""

    def __post_init__(self):
        if self.kind not in ("INVALID", "NEEDS_CLARIFICATION"):
            raise ConfigError(f"a rule can't return {self.kind}")


def screened(df: DataFrame, columns: list[str]) -> Column:
    """Whether any of the text columns holds an injection."""
    reasons = [F.coalesce(injection_reason(F.col(c)) != "ok", F.lit(False)) for c in columns]
    return reduce(or_, reasons, F.lit(False))


def masked_inputs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with every one of the text columns masked, and the redactions summed by label."""
    out = df.withColumn("redactions", F.create_map().cast("map<string,int>"))
    for c in columns:
        out = mask(out, c, counts_col="_one")
        out = out.withColumn("redactions", F.map_zip_with("redactions", F.coalesce("_one", F.create_map().cast("map<string,int>")), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))).drop("_one")
    return out


def extract(df: DataFrame, schema: Schema, generate, *, text_col: str = "text", prior_col: str | None = None, inputs: tuple[str, ...] = (), retries: int = 1, screen: bool = False, masked: bool = False, ungrounded: str = "ignore", rules: tuple[Rule, ...] = ()) -> DataFrame:
    """``df`` with status, data (JSON), issues, fields (provenance and quote by path), attempts, question and missing.

    generate(text, attempt) -> reply, or a list of such functions, one per provider: each is called in
    Arrow batches, at most 1 + retries times a row, until a reply parses and validates; the first usable
    one wins. Missing values are never retried, empty texts never sent. prior_col: JSON of earlier turns,
    less what no longer fits the schema; null and empty lists keep it. inputs: further text columns, such
    as history and reference; screen blocks rows with an injection in any of all inputs, without a call,
    masked replaces personal data in all of them first. ungrounded: "invalid" makes values without
    support in the text issues. rules are checked last, on the column ``data``.
    """
    if ungrounded not in ("ignore", "invalid"):
        raise ConfigError(f"unknown way with ungrounded values {ungrounded!r}")
    every = [text_col, *inputs, *([prior_col] if prior_col else [])]
    if masked:
        df = masked_inputs(df, every)
    providers = list(generate) if isinstance(generate, (list, tuple)) else [generate]

    def reply_of(text: str):
        """(reply object, coerced data, issues, attempts): the first that is usable, else the last that held an object."""
        attempts, best = 0, (None, None, [])
        for provider in providers:
            for turn in range(1 + retries):
                attempts += 1
                try:
                    found = parse_object(provider(text, turn))
                except Exception:  # a provider that fails is one without a usable reply
                    found = None
                inner = found.get("data") if found else None
                if isinstance(inner, dict):
                    data, issues = validate(inner, schema.fields)
                    best = found, data, issues
                    if not any(i["kind"] == "INVALID" for i in issues):
                        return *best, attempts
        return *best, attempts

    def judged(text: str | None, prior: str | None):
        earlier = None
        if prior:
            try:
                earlier = drop_invalid(json.loads(prior), schema.fields)
            except ValueError:
                earlier = None
        text = text or ""
        found, data, issues, attempts = reply_of(text) if text.strip() else ({}, {}, [], 0)
        if data is None:
            return None, [], None, attempts, True
        if earlier is not None or not text.strip():
            data, again = validate(deep_merge(earlier, data) or {}, schema.fields)
            issues = [i for i in issues if i["kind"] == "INVALID"] + [i for i in again if i["kind"] != "INVALID"]
        quotes = found.get("evidence") if isinstance(found.get("evidence"), dict) else {}
        fields = {}
        for path, value in leaves(data):
            at = pointer(path)
            quote = quotes.get(at) if isinstance(quotes.get(at), str) and quotes[at].strip() else None
            where = evidence(value, quote, text, lookup(earlier, path))
            fields[at] = {"provenance": where, "quote": quote if where in ("SOURCE", "MISMATCH", "UNGROUNDED") else None}
            if ungrounded == "invalid" and where in ("MISMATCH", "UNGROUNDED"):
                issues.append({"kind": "INVALID", "code": where, "path": at})
        return json.dumps(data, ensure_ascii=False), issues, list(fields.items()), attempts, False

    @F.pandas_udf(f"data string, issues {ISSUES}, fields array<struct<path:string,provenance:string,quote:string>>, attempts int, failed boolean")
    def run(texts: pd.Series, priors: pd.Series) -> pd.DataFrame:
        rows = []
        for text, prior in zip(texts, priors, strict=True):
            data, issues, fields, attempts, failed = judged(text, prior)
            rows.append((data, issues, fields and [{"path": path, **report} for path, report in fields], attempts, failed))
        return pd.DataFrame(rows, columns=["data", "issues", "fields", "attempts", "failed"])

    prior = F.col(prior_col).cast("string") if prior_col else F.lit(None).cast("string")
    marked = df.withColumn("_blocked", screened(df, every) if screen else F.lit(False))
    live = marked.where("not _blocked").withColumn("_x", run(F.col(text_col), prior))
    stopped = marked.where("_blocked").withColumn("_x", F.lit(None).cast(live.schema["_x"].dataType))
    out = live.unionByName(stopped) if screen else live
    issues = F.coalesce("_x.issues", F.array().cast(ISSUES))
    fields = F.map_from_entries(F.transform("_x.fields", lambda f: F.struct(f["path"].alias("key"), F.struct(f["provenance"].alias("provenance"), f["quote"].alias("quote")).alias("value")))).cast(FIELDS)
    out = out.withColumns({"data": F.col("_x.data"), "issues": issues, "fields": fields, "attempts": F.coalesce("_x.attempts", F.lit(0)), "_failed": F.coalesce("_x.failed", F.lit(False))})
    for rule in rules:
        issue = F.array(F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.code).alias("code"), F.lit(rule.path).alias("path")))
        out = out.withColumn("issues", F.when(F.col("data").isNotNull() & F.coalesce(rule.broken, F.lit(False)), F.concat("issues", issue)).otherwise(F.col("issues")))
    out = out.withColumn("status", status(F.col("issues"), F.col("_blocked"), F.col("_failed")))
    missing = F.transform(F.filter("issues", lambda i: i["kind"] == "NEEDS_CLARIFICATION"), lambda i: i["path"])
    return out.withColumns({"question": clarification(schema, F.col("issues")), "missing": missing}).drop("_x", "_blocked", "_failed")


def preview(df: DataFrame, schema: Schema, *, text_col: str = "text", salt_col: str, history: str | None = None, reference: str | None = None, prior: str | None = None, **prompt) -> DataFrame:
    """``df`` with system_prompt and user_prompt of an extraction that isn't run."""
    from . import prompts

    column = lambda c: None if c is None else F.col(c).cast("string")
    user = prompts.extraction_prompt(text=F.col(text_col), salt=F.col(salt_col), history=column(history), reference=column(reference), prior=column(prior))
    return df.withColumns({"system_prompt": F.lit(prompts.extraction_system_prompt(schema, **prompt)), "user_prompt": user})


def fold_turns(turns: DataFrame, schema: Schema, *, conv_col: str = "conv_id", turn_col: str = "turn", data_col: str = "data") -> DataFrame:
    """(conv_id, turn, merged): the data of each turn merged over all earlier ones of its conversation, as JSON.

    One group is one conversation; state is the merged object, so its size is that of the schema.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        held, rows = None, []
        for row in frame.sort_values(turn_col).itertuples(index=False):
            try:
                current = json.loads(getattr(row, data_col) or "null")
            except ValueError:
                current = None
            held = deep_merge(drop_invalid(held, schema.fields), current if isinstance(current, dict) else None)
            rows.append((getattr(row, conv_col), getattr(row, turn_col), json.dumps(held, ensure_ascii=False)))
        return pd.DataFrame(rows, columns=[conv_col, turn_col, "merged"])

    kinds = {c: turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)}
    return turns.select(conv_col, turn_col, data_col).groupBy(conv_col).applyInPandas(fold, f"{conv_col} {kinds[conv_col]}, {turn_col} {kinds[turn_col]}, merged string")


@dataclass(frozen=True)
class Steps:
    """Named steps, each a function of a DataFrame; one of them is "extract", which can't be left out."""

    steps: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...]
    off: frozenset = frozenset()

    def __post_init__(self):
        names = [name for name, _ in self.steps]
        if len(set(names)) < len(names) or not all(names):
            raise ConfigError("steps need unique names")
        if "extract" not in names or "extract" in self.off:
            raise ConfigError("the step extract can't be left out")
        if unknown := sorted(set(self.off) - set(names)):
            raise ConfigError(f"unknown steps: {', '.join(unknown)}")

    def _at(self, name: str) -> int:
        names = [n for n, _ in self.steps]
        if name not in names:
            raise ConfigError(f"unknown step {name}")
        return names.index(name)

    def add(self, name: str, step, *, before: str | None = None, after: str | None = None) -> Steps:
        at = self._at(before) if before else self._at(after) + 1 if after else len(self.steps)
        return Steps((*self.steps[:at], (name, step), *self.steps[at:]), self.off)

    def remove(self, name: str) -> Steps:
        at = self._at(name)
        return Steps((*self.steps[:at], *self.steps[at + 1 :]), self.off - {name})

    def replace(self, name: str, step) -> Steps:
        at = self._at(name)
        return Steps((*self.steps[:at], (name, step), *self.steps[at + 1 :]), self.off)

    def disable(self, name: str) -> Steps:
        self._at(name)
        return Steps(self.steps, self.off | {name})

    def enable(self, name: str) -> Steps:
        return Steps(self.steps, self.off - {name})

    def run(self, df: DataFrame) -> DataFrame:
        """The steps in order. Plans are made here, so a failing step is named; what fails in a task fails with the job."""
        for name, step in self.steps:
            if name in self.off:
                continue
            try:
                df = step(df)
            except Exception as error:
                raise EngineError(f"step {name}: {error}") from error
        return df


def conversation_slots(turns: DataFrame, slots: dict[str, str], *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Each slot's value after every turn: the pattern's first group where it matches, else the value before.

    The fold of turns is a last-non-null window, linear in the turns and split by conversation.
    """
    order = Window.partitionBy(conv_col).orderBy(turn_col).rowsBetween(Window.unboundedPreceding, 0)
    found = {name: F.nullif(F.regexp_extract(F.col(text_col), pattern, 1), F.lit("")) for name, pattern in slots.items()}
    return turns.select(conv_col, turn_col, *(F.last(c, ignorenulls=True).over(order).alias(name) for name, c in found.items()))


def route(df: DataFrame, rules: list[tuple[str, Column]], otherwise: Column | None = None, known: set[str] | None = None) -> DataFrame:
    """``df`` with route: the first rule that holds, else the fallback's name, else NO_MATCH; an unknown name raises."""
    chosen = F.coalesce(*(F.when(condition, name) for name, condition in rules), otherwise if otherwise is not None else F.lit(None).cast("string"))
    if known is not None:
        chosen = F.when(chosen.isNull() | chosen.isin(*known), chosen).otherwise(F.raise_error(F.concat(F.lit("unknown route "), chosen)))
    return df.withColumn("route", F.coalesce(chosen, F.lit("NO_MATCH")))


def summarise_json(context: Column) -> Column:
    """Summary of a flat JSON object, natively: k=v of the keys of interest, in order; else the collapsed text's start."""
    pairs = F.map_entries(F.from_json(context, "map<string,string>"))
    wanted = F.filter(pairs, lambda e: F.replace(F.lower(e["key"]), F.lit(" "), F.lit("")).isin(*SUMMARY_KEYS))
    listed = F.array_join(F.transform(wanted, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    collapsed = F.substring(F.trim(F.regexp_replace(context, r"\s+", " ")), 1, SUMMARY_LENGTH)
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, listed).otherwise(F.coalesce(collapsed, F.lit("")))


def summary(context: str | None) -> str:
    """Summary of any context: nested JSON, else XML without DTD, else the collapsed start."""
    text = (context or "")[:CONTEXT_LIMIT]
    found: dict[str, str] = {}

    def keep(key, value):
        if str(key).lower().replace(" ", "") in SUMMARY_KEYS:
            found.setdefault(str(key), str(value))

    def walk(node):
        for key, value in node.items() if isinstance(node, dict) else ((None, v) for v in node):
            if isinstance(value, (dict, list)):
                walk(value)
            elif key is not None:
                keep(key, value)

    try:
        parsed = json.loads(text)
        if isinstance(parsed, (dict, list)):
            walk(parsed)
    except ValueError:
        if text.lstrip().startswith("<") and not re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
            from xml.etree import ElementTree

            try:
                nodes = list(ElementTree.fromstring(text.strip()).iter())
            except ElementTree.ParseError:
                nodes = []
            for node in nodes:
                if (node.text or "").strip():
                    keep(node.tag.rpartition("}")[2], node.text.strip())
            for node in nodes:
                for key, value in node.attrib.items():
                    keep(key, value)
    return "; ".join(f"{k}={v}" for k, v in found.items()) or re.sub(r"\s+", " ", text).strip()[:SUMMARY_LENGTH]


def summarise(context: Column) -> Column:
    """``summary`` in Arrow batches, for contexts of arbitrary shape."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(summary)

    return run(context)
