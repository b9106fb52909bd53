"""Text privacy: ordered replacement rules as column expressions."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_YEAR = r"(?:1[7-9]\d{2}|20[0-1]\d|202[0-3])"
#: fixed values: the rules of a scrub in their order; (?U) makes \w and \b know all scripts
SCRUB_RULES = (
    ("identifier", rf"(?U)\b(?:\w{{0,40}}[\p{{L}}_]\w{{0,40}}{_YEAR}\w{{0,40}}|\w{{0,40}}{_YEAR}\w{{0,40}}[\p{{L}}_]\w{{0,40}})\b", "[IDENTIFIER]"),
    ("year", rf"(?U)\b{_YEAR}\b", "[YEAR]"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("phone", r"(?U)\+1[-.\s]+\(?[0-9]{3}\)?[-.\s]*[0-9]{3}[-.\s]*[0-9]{4}|\([0-9]{3}\)[-.\s]*[0-9]{3}[-.\s]*[0-9]{4}|\b[0-9]{3}[-.\s]+[0-9]{3}[-.\s]+[0-9]{4}\b", "[PHONE]"),
    ("ip", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_ADDRESS]"),
    ("url", r"(?U)https?://[^\s<>]+", "[URL]"),
    ("ssn", r"(?U)\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("card", r"(?U)\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CREDIT_CARD]"),
)
#: fixed values: what log lines must not show
LOG_RULES = (
    (r"Bearer [A-Za-z0-9\-_\.]+", "Bearer [REDACTED]"),
    (r"token=[A-Za-z0-9\-_\.]+", "token=[REDACTED]"),
    (r"password=\S+", "password=[REDACTED]"),
    (r"secret=\S+", "secret=[REDACTED]"),
    (r"api_key=\S+", "api_key=[REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CARD]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
)
#: fixed values: signs of an attack by name
ATTACKS = (
    ("xss_script", r"(?is)<script[^>]*>.*?</script>"), ("xss_script_tag", r"(?i)<script[^>]*>"), ("xss_script_close", r"(?i)</script>"), ("xss_event_handler", r"""(?i)\bon\w+\s*=\s*["'][^"']*["']"""),
    ("xss_event_handler_unquoted", r"(?i)\bon\w+\s*=\s*[^\s>]+"), ("xss_javascript_url", r"""(?i)javascript\s*:[^"'>\s]*"""), ("xss_vbscript_url", r"""(?i)vbscript\s*:[^"'>\s]*"""), ("xss_data_url", r"(?i)data\s*:[^,]*;base64"),
    ("xss_iframe", r"(?is)<iframe[^>]*>.*?</iframe>"), ("xss_iframe_tag", r"(?i)<iframe[^>]*>"), ("xss_object", r"(?is)<object[^>]*>.*?</object>"), ("xss_embed", r"(?i)<embed[^>]*>"), ("xss_svg_onload", r"(?i)<svg[^>]*\s+onload\s*="),
    ("xss_img_onerror", r"(?i)<img[^>]*\s+onerror\s*="), ("xss_body_onload", r"(?i)<body[^>]*\s+onload\s*="), ("xss_style_expression", r"(?i)expression\s*\("), ("xss_style_import", r"(?i)@import\s+"),
    ("sql_union_select", r"(?i)\bUNION\s+(?:ALL\s+)?SELECT\b"), ("sql_drop", r"(?i)\bDROP\s+(?:TABLE|DATABASE|INDEX)\b"), ("sql_delete_from", r"(?i)\bDELETE\s+FROM\b"), ("sql_insert_into", r"(?i)\bINSERT\s+INTO\b"),
    ("sql_update_set", r"(?i)\bUPDATE\s+\w+\s+SET\b"), ("sql_exec", r"(?i)\b(?:EXEC|EXECUTE)\s*\("), ("sql_xp_cmdshell", r"(?i)\bxp_cmdshell\b"), ("sql_comment", r"(--|#|/\*|\*/)"), ("sql_or_1_equals_1", r"(?i)'\s*OR\s+'?\d+'\s*=\s*'?\d+"),
    ("sql_semicolon_command", r"(?i);\s*(?:DROP|DELETE|INSERT|UPDATE|EXEC)"), ("cmd_shell", r"(?i)[;&|`$]\s*(?:sh|bash|cmd|powershell)"), ("cmd_backtick", r"`[^`]+`"), ("cmd_subshell", r"\$\([^)]+\)"), ("path_traversal", r"\.\.[\\/]"), ("null_byte", r"%00|\x00"),
)
#: what a text must hold for any sign of an attack to match: one cheap search spares most names all of them
ATTACK_GUARD = r"(?i)[<=;(@\s#*&|`$%'\x00]|script\s*:|xp_|--|\.\."
MAX_TEXT, MAX_IDENTIFIER, MAX_ARRAY, MAX_DEPTH = 100_000, 256, 1000, 20
#: fixed values: keys of ids that no rule touches, keys whose text is scrubbed, and keys whose text is sanitised
STRUCTURAL_KEYS = ("agent_id_hash", "trace_id", "thought_id", "task_id", "span_id", "correlation_id", "signature_key_id", "signing_key_id", "channel_id")
SCRUB_FIELDS = (
    "task_description", "initial_context", "thought_content", "system_snapshot", "gathered_context", "relevant_memories", "conversation_history", "reasoning", "prompt_used", "combined_analysis",
    "action_rationale", "reasoning_summary", "action_parameters", "aspdma_prompt", "conscience_override_reason", "epistemic_data", "updated_status_content", "entropy_reason", "coherence_reason",
    "optimization_veto_justification", "epistemic_humility_justification", "execution_error", "intervention_recommendation", "next_best_recovery_step", "correlation_factors", "top_correlation_factors",
    "common_cause_flags", "sources_identified", "source_ids", "source_clusters", "source_types", "source_type_counts", "pairwise_correlation_summary", "reasoning_state", "flags", "alignment_check", "conflicts",
    "stakeholders", "questions", "completion_reason", "current_thought_summary", "epistemic_humility_uncertainties",
)
SANITIZE_FIELDS = (
    "task_description", "initial_context", "system_snapshot", "gathered_context", "relevant_memories", "conversation_history", "reasoning", "prompt_used", "combined_analysis", "action_rationale", "reasoning_summary",
    "action_parameters", "aspdma_prompt", "conscience_override_reason", "epistemic_data", "updated_status_content", "entropy_reason", "coherence_reason", "optimization_veto_justification",
    "epistemic_humility_justification", "execution_error", "agent_name", "domain", "codename", "agent_id", "trace_id", "thought_id", "task_id",
)
IDENTIFIER_FIELDS = ("trace_id", "thought_id", "task_id", "agent_id", "agent_id_hash", "agent_name", "signature_key_id")


#: what a text must hold for a rule to match: a cheap search spares most texts the costly one
_GUARDS = {"identifier": r"(?U)(?:1[7-9]|20)\d\d", "year": r"(?U)(?:1[7-9]|20)\d\d", "email": "@", "phone": "[0-9]{3}", "ip": r"(?U)\d\.\d", "url": "://", "ssn": r"(?U)\d-\d", "card": r"(?U)\d{4}"}
#: where a text can be cut, as no match of a rule holds a blank with a letter behind it, and what each match holds: most pieces need no rule
_CUT, _HELD = r"(?<=[\t-\r ])(?=\p{L})", r"[\p{Nd}@]|://"


def _step(name: str, pattern: str, replacement: str):  # noqa: ANN202
    return lambda x: F.when(x.rlike(_GUARDS[name]), F.regexp_replace(x, pattern, F.lit(replacement))).otherwise(x)


def matchable(column: Column) -> Column:
    """What the rules have to read of a text to find all their matches in it."""
    return F.array_join(F.filter(F.split(column, _CUT), lambda x: x.rlike(_HELD)), "")


def scrub_text(column: Column) -> Column:
    """The text after all rules, which only the pieces that may hold a match go through.

    Each rule is a step over an array of the one piece, so that a rule's input is
    computed once although the step names it three times.
    """

    def ruled(piece: Column) -> Column:
        held = F.array(piece)
        for rule in SCRUB_RULES:
            held = F.transform(held, _step(*rule))
        return F.when(piece.rlike(_HELD), held[0]).otherwise(piece)

    return F.array_join(F.transform(F.split(column, _CUT), ruled), "")


def redaction_counts(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the matches of each rule, counted after the rules before it; none in a null text.

    Only the pieces of a text that may hold a match are read by the rules.
    """
    df = df.withColumn("__scrub", matchable(F.col(column)))
    for name, pattern, replacement in SCRUB_RULES:
        text = F.col("__scrub")
        df = df.withColumn(f"n_{name}", F.when(text.rlike(_GUARDS[name]), F.regexp_count(text, F.lit(pattern))).otherwise(0))
        df = df.withColumn("__scrub", F.transform(F.array(text), _step(name, pattern, replacement))[0])
    return df.drop("__scrub")


def residue(column: Column, probes: Iterable[str] = ()) -> Column:
    """Whether a year or a probe term is left."""
    found = column.rlike(SCRUB_RULES[1][1])
    for probe in probes:
        found = found | F.lower(column).contains(probe.lower())
    return found


def residue_gate(df: DataFrame, column: str, probes: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) rows; a null text is clean."""
    bad = F.coalesce(residue(F.col(column), list(probes)), F.lit(False))
    return df.where(~bad), df.where(bad)


def scrub_by_level(df: DataFrame, text: str, level: str) -> DataFrame:
    """Generic rows pass, detailed ones are scrubbed, full ones are rejected for want of a name recogniser."""
    done = F.when(F.col(level) == "detailed", scrub_text(F.col(text))).when(F.col(level) == "generic", F.col(text))
    return df.withColumn("scrubbed", done).withColumn("rejected", F.coalesce(F.col(level) == "full_traces", F.lit(False)))


def rescrub_report(df: DataFrame, column: str, probes: Iterable[str] = ()) -> DataFrame:
    """Rows, changed rows, rows kept or rejected by the residue gate, and rows with a residue before and after a scrub."""
    before, after = F.col(column), scrub_text(F.col(column))
    left = F.coalesce(residue(after, list(probes)), F.lit(False))
    return df.agg(
        F.count("*").alias("n"), F.count_if(before != after).alias("changed"), F.count_if(~left).alias("kept"), F.count_if(left).alias("rejected"),
        F.count_if(residue(before, list(probes))).alias("residue_before"), F.count_if(residue(after, list(probes))).alias("residue_after"),
    )


def redact_log(column: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], F.lit(rule[1])), LOG_RULES, column)


def hash_user(column: Column) -> Column:
    return F.substring(F.sha2(column, 256), 1, 16)


def detect_patterns(column: Column) -> Column:
    """Names of the attack signs in a text."""
    return F.array_compact(F.array(*[F.when(column.rlike(pattern), F.lit(name)) for name, pattern in ATTACKS]))


def _escaped(column: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        column = F.replace(column, F.lit(raw), F.lit(entity))
    return column


def _placeholder(name: str) -> str:
    kind = name.split("_")[0]
    return {"path": "[PATH_REMOVED]", "null": "[NULL_BYTE_REMOVED]"}.get(kind, f"[{kind.upper()}_REMOVED:{name}]")


def _replaced(column: Column, replacement) -> Column:  # noqa: ANN001
    """struct(value, names): the text with every attack sign replaced, one after the other, and which were met.

    Each rule is a step over an array of the one pair, so that a rule's input is
    computed once although the step names it three times.  A text without what every
    sign needs takes no step.
    """

    def steps(pair: Column) -> Column:
        held = F.array(pair)
        for name, pattern in ATTACKS:
            held = F.transform(held, _replacing(name, pattern, replacement(name)))
        return F.when(pair["value"].rlike(ATTACK_GUARD), held[0]).otherwise(pair)

    return F.transform(F.array(F.struct(column.alias("value"), F.array().cast("array<string>").alias("names"))), steps)[0]


def _replacing(name: str, pattern: str, placeholder: str):  # noqa: ANN202
    def step(pair: Column) -> Column:
        met = F.coalesce(pair["value"].rlike(pattern), F.lit(False))
        done = F.struct(F.regexp_replace(pair["value"], pattern, F.lit(placeholder)).alias("value"), F.array_append(pair["names"], F.lit(name)).alias("names"))
        return F.when(met, done).otherwise(pair)

    return step


def sanitize_text(column: Column, identifier: bool = False, most: int | None = None) -> Column:
    """struct(value, detections, was_truncated, was_modified): cut, neutralise, and escape what was changed."""
    most = most or (MAX_IDENTIFIER if identifier else MAX_TEXT)

    def finish(pair: Column) -> Column:
        text, long = pair["text"], F.coalesce(F.length(pair["text"]) > most, F.lit(False))
        value = pair["done"]["value"]
        value = value if identifier else F.when(value != text, _escaped(value)).otherwise(value)
        detections = F.concat(F.when(long, F.array(F.lit("size_limit_exceeded"))).otherwise(F.array().cast("array<string>")), pair["done"]["names"])
        return F.struct(value.alias("value"), detections.alias("detections"), long.alias("was_truncated"), F.coalesce(value != text, F.lit(False)).alias("was_modified"))

    cut = F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("[TRUNCATED]"))).otherwise(column)
    return F.transform(F.array(F.struct(column.alias("text"), _replaced(cut, _placeholder).alias("done"))), finish)[0]


def rewrite_strings(df: DataFrame, columns: list[str], rule, protected: tuple[str, ...] = ()) -> DataFrame:  # noqa: ANN001
    """Applies ``rule`` to every string inside the given columns, however nested; protected fields stay."""

    def walk(value: Column, kind: T.DataType, name: str) -> Column:
        if name in protected:
            return value
        if isinstance(kind, T.StringType):
            return rule(value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType, ""))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, x: walk(x, kind.valueType, ""))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[walk(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        return value

    return df.withColumns({c: walk(F.col(c), df.schema[c].dataType, c) for c in columns})


def validate_number(column: Column, low: float, high: float) -> Column:
    """struct(value, issues): a number inside the bounds, and what was wrong with it."""
    number = F.expr("cast(null as double)") if column is None else column.try_cast("double")
    broken = number.isNull() & column.isNotNull()
    odd = F.isnan(number) | (F.abs(number) == float("inf"))
    value = F.when(odd, F.lit(None)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), number)))
    issues = F.array_compact(F.array(F.when(broken, F.lit("type")), F.when(odd, F.lit("not_finite")), F.when(~odd & (number < low), F.lit("low")), F.when(~odd & (number > high), F.lit("high"))))
    return F.struct(F.when(number.isNotNull(), value).alias("value"), issues.alias("issues"))


def validate_identifier(column: Column, name: str) -> Column:
    """struct(value, issues): cut at the limit; if there are signs of an attack, all of them taken out."""

    def finish(pair: Column) -> Column:
        long = F.coalesce(F.length(pair["text"]) > MAX_IDENTIFIER, F.lit(False))
        found = detect_patterns(pair["cut"])
        value = F.when(F.size(found) > 0, pair["done"]["value"]).otherwise(pair["cut"])
        issues = F.concat(F.when(long, F.array(F.lit(f"{name}_truncated"))).otherwise(F.array().cast("array<string>")), found)
        return F.struct(value.alias("value"), F.when(pair["text"].isNull(), F.array().cast("array<string>")).otherwise(issues).alias("issues"))

    cut = F.substring(column, 1, MAX_IDENTIFIER)
    return F.transform(F.array(F.struct(column.alias("text"), cut.alias("cut"), _replaced(cut, lambda _: "").alias("done"))), finish)[0]


def validate_models(column: Column, most: int = MAX_ARRAY) -> Column:
    """struct(value, issues): names of a JSON list, or of one name that is no JSON; nulls out, each sanitised, ``most`` at most.

    The text is parsed once.  A list whose names hold nothing that a sign of an attack needs, and
    none of which is too long, is searched as one text; only of others is each name sanitised.
    """
    none = F.array().cast("array<string>")

    def listed(held: Column) -> Column:
        text, is_list = held["text"], F.coalesce(F.schema_of_variant(held["parsed"]).startswith("ARRAY"), F.lit(False))
        names = F.when(text.isNull(), none).when(held["parsed"].isNull(), F.array(text)).when(is_list, F.from_json(text, "array<string>")).otherwise(none)
        return F.struct(text.alias("text"), (held["parsed"].isNotNull() & ~is_list).alias("odd"), F.array_compact(names).alias("names"))

    def sanitised(held: Column) -> Column:
        names = held["names"]
        different = F.array_distinct(names)
        odd = F.array_join(different, ",").rlike(ATTACK_GUARD) | F.exists(different, lambda x: F.length(x) > MAX_IDENTIFIER)
        each = F.transform(names, lambda x: sanitize_text(x, identifier=True))
        dirty = F.transform(F.array(each), lambda e: F.struct(F.transform(e, lambda x: x["value"]).alias("names"), F.flatten(F.transform(e, lambda x: x["detections"])).alias("found")))[0]
        clean = F.when(odd, dirty).otherwise(F.struct(names.alias("names"), none.alias("found")))
        return F.struct(held["text"].alias("text"), held["odd"].alias("odd"), clean.alias("clean"))

    def finish(held: Column) -> Column:
        names = held["clean"]["names"]
        issues = F.array_compact(F.array(F.when(held["text"].isNotNull(), F.lit("models_used_was_string")), F.when(held["odd"], F.lit("models_used_invalid_type"))))
        long = F.when(F.size(names) > most, F.array(F.lit("models_used_truncated"))).otherwise(none)
        return F.struct(F.slice(names, 1, most).alias("value"), F.concat(issues, held["clean"]["found"], long).alias("issues"))

    held = F.transform(F.array(column), lambda x: F.struct(x.alias("text"), F.try_parse_json(x).alias("parsed")))
    return F.transform(F.transform(F.transform(held, listed), sanitised), finish)[0]


def sanitize_nested(df: DataFrame, columns: list[str], most: int = MAX_ARRAY) -> DataFrame:
    """Sanitises every string of the typed columns, however nested, and cuts arrays at ``most`` entries."""
    cut = {c: F.slice(F.col(c), 1, most) for c in columns if isinstance(df.schema[c].dataType, T.ArrayType)}
    return rewrite_strings(df.withColumns(cut) if cut else df, columns, lambda v: sanitize_text(v)["value"])


# JSON text of no known type is walked in Python row by row: texts may be long, and a batch by rows would hold many of them


def _python(pattern: str):  # noqa: ANN202
    """A rule of the lists above as Python's ``regex`` has it; (?U) is its default."""
    import regex

    return regex.compile(pattern.replace("(?U)", ""))


_COMPILED: dict[str, list] = {}


def _rules(kind: str) -> list:
    """The compiled rules of a worker, made once."""
    if kind not in _COMPILED:
        _COMPILED[kind] = [(name, _python(p), r) for name, p, r in SCRUB_RULES] if kind == "scrub" else [(name, _python(p), _placeholder(name)) for name, p in ATTACKS]
    return _COMPILED[kind]


def scrub_python(text: str) -> str:
    """``scrub_text`` of one Python string."""
    for _, pattern, replacement in _rules("scrub"):
        text = pattern.sub(replacement, text)
    return text


def sanitize_python(text: str, identifier: bool = False) -> tuple[str, list[str], bool, bool]:
    """``sanitize_text`` of one Python string: value, detections, whether changed and whether cut."""
    most, out, found = MAX_IDENTIFIER if identifier else MAX_TEXT, text, []
    if len(text) > most:
        out, found = text[:most] + "[TRUNCATED]", ["size_limit_exceeded"]
    for name, pattern, replacement in _rules("attacks"):
        if pattern.search(out):
            found.append(name)
            out = pattern.sub(replacement, out)
    if out != text and not identifier:
        out = html.escape(out, quote=True)
    return out, found, out != text, len(text) > most


def _scrub_all(value: object, protected: frozenset[str]) -> object:
    if isinstance(value, str):
        return scrub_python(value)
    if isinstance(value, list):
        return [_scrub_all(v, protected) for v in value]
    return {k: v if k in protected else _scrub_all(v, protected) for k, v in value.items()} if isinstance(value, dict) else value


def _scrub_fields(value: object, fields: frozenset[str] | None, protected: frozenset[str], depth: int) -> object:
    if fields is None:
        return _scrub_all(value, protected)
    if depth > MAX_DEPTH or not isinstance(value, (dict, list)):
        return value
    if isinstance(value, list):
        return [_scrub_fields(v, fields, protected, depth + 1) for v in value]
    return {k: v if k in protected else _scrub_all(v, protected) if k in fields else _scrub_fields(v, fields, protected, depth + 1) for k, v in value.items()}


#: half a surrogate pair: JSON may name one, UTF-8 has none
_LONE = re.compile("[\ud800-\udfff]")


def _json_text(value: object) -> str:
    """Compact JSON; halves of surrogate pairs become the replacement character."""
    return _LONE.sub("\ufffd", json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _walked(text: str | None, change) -> str | None:  # noqa: ANN001
    """A JSON text after ``change`` of what it holds.

    Text that is no JSON, or is nested deeper than Python follows, is changed as one
    string.  Numbers that JSON does not know (NaN, Infinity) become null.
    """
    if text is None:
        return None
    try:
        return _json_text(change(json.loads(text, parse_constant=lambda _: None)))
    except (ValueError, RecursionError):
        return _LONE.sub("\ufffd", change(text))


def unreadable(column: Column) -> Column:
    """Whether a text that begins like a JSON object or list can't be read as one: broken, or nested too deep."""
    return F.coalesce(column.rlike(r"^\s*[\[{]") & F.try_parse_json(column).isNull(), F.lit(False))


def scrub_json(column: Column, fields: Iterable[str] | None = SCRUB_FIELDS, protected: Iterable[str] = STRUCTURAL_KEYS) -> Column:
    """JSON text with every string under a listed key scrubbed (of all keys if there is no list); structural ids stay.

    The text is parsed first, so numbers and structure never change.
    """
    listed, kept = None if fields is None else frozenset(fields), frozenset(protected)

    @F.udf("string", useArrow=False)
    def run(text: str | None) -> str | None:
        return _walked(text, lambda v: _scrub_fields(v, listed, kept, 0))

    return run(column)


class _Sanitizer:
    """Walks one JSON value; counts what it met."""

    def __init__(self) -> None:
        self.found, self.modified, self.cut = [], 0, 0

    def text(self, value: str, identifier: bool = False) -> str:
        out, found, changed, cut = sanitize_python(value, identifier)
        self.found += found
        self.modified += changed
        self.cut += cut
        return out

    def walk(self, value: object, depth: int = 0) -> object:
        if depth > MAX_DEPTH:
            self.found.append("depth_limit_exceeded")
            self.modified += 1
            return "[DEPTH_LIMIT_EXCEEDED]"
        if isinstance(value, list):
            if len(value) > MAX_ARRAY:
                self.found.append("array_truncated")
            return [self.text(v) if isinstance(v, str) else self.walk(v, depth + 1) if isinstance(v, (dict, list)) else v for v in value[:MAX_ARRAY]]
        if not isinstance(value, dict):
            return self.text(value) if isinstance(value, str) else value
        out = {}
        for key, v in value.items():
            if len(key) > MAX_IDENTIFIER:
                self.found.append("key_truncated")
                key = key[:MAX_IDENTIFIER]
            if isinstance(v, str):
                out[key] = self.text(v, key in IDENTIFIER_FIELDS) if key in SANITIZE_FIELDS else v
            else:
                out[key] = self.walk(v, depth + 1) if isinstance(v, (dict, list)) else v
        return out


def sanitize_json(column: Column) -> Column:
    """struct(value, detections, modified, truncated) of JSON text: listed fields neutralised, keys, arrays and depth bounded."""

    @F.udf("value string, detections array<string>, modified int, truncated int", useArrow=False)
    def run(text: str | None) -> tuple:
        walker = _Sanitizer()
        value = _walked(text, walker.walk)
        return value, sorted(set(walker.found)), walker.modified, walker.cut

    return run(column)


def scrub_stats(tr: DataFrame, since: str, until: str) -> DataFrame:
    """Traces and scrubbed ones of a window by level."""
    rows = tr.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") <= F.lit(until).cast("timestamp")))
    return rows.groupBy("trace_level").agg(F.count("*").alias("n"), F.count_if("pii_scrubbed").alias("scrubbed"))
