"""Chat formatting with DataFrame functions only: tool calls linked to their results, ordered, validated and serialised.

Calls and results are hash-joined by conversation and call identifier. A linked result comes right behind its call,
whatever turn it came in. A call depends on another call of its conversation if a string in its arguments is
that call's identifier; it then comes behind that call's result. ``rank`` sorts each conversation topologically:
it is twice the turn, moved up where a dependency asks for it. Calls that depend on one another in a ring, and
what depends on them, keep the rank of their turn and are not ``ordered``.

Arguments are parsed with their JSON types and validated against the fields of the call's schema; an object that
names a key twice is not valid JSON here. Each message is written as canonical JSON: keys in order at every level,
no spaces, null fields left out. Its arguments are a string that holds canonical JSON, or what came where that is no JSON.
Numbers keep all their digits and have one form each: 100, 1e2 and 100.0 are written 100, and are integers.

Null identifiers and conversations link nothing. Of repeated calls with one identifier the first turn counts, and they
are valid together only if each is; each row still gives its own message. Results without a call and
calls without a result are kept as such. Empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import _shared

#: What the type of an argument's JSON value is called in a variant, by the type a schema names; numbers travel as strings.
TYPE_PATTERNS = {"string": "STRING", "integer": "STRING", "number": "STRING", "boolean": "BOOLEAN", "array": "(?s)ARRAY<.*>", "object": "(?s)OBJECT<.*>"}
#: What a string is led by that stands for an integer or another number; other strings led by the mark are marked themselves.
_MARK = "\x01"
_INTEGER, _NUMBER, _STRING = _MARK + "i", _MARK + "n", _MARK + "s"
_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|[^"0-9-]++|.'
#: Numbers of so many digits before the point, or more if all of them are written, have no exponent.
PLAIN_DIGITS = 21

Schema = list[tuple[str, str, bool]]


def canonical_number(token: Column) -> Column:
    """A JSON number digit by digit in one form for equal numbers: 1e2 and 100.0 are 100; null if its exponent is beyond a long."""
    part = lambda i: F.regexp_extract(token, r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", i)
    given = F.when(part(3) == "", F.lit(0).cast("long")).otherwise(F.try_to_number(F.regexp_replace(part(3), r"^\+?(-?)0*(?=[0-9])", "$1"), F.lit("S" + "9" * 18)).cast("long"))
    written = F.regexp_replace(F.concat(part(1), part(2)), "^0+", "")
    digits = F.regexp_replace(written, "0+$", "")
    scale = given - F.length(part(2)) + (F.length(written) - F.length(digits))

    def form(x: Column) -> Column:
        d, e = x["d"], x["e"]
        n = F.length(d)
        point = n + e
        plain = (point <= F.greatest(F.lit(PLAIN_DIGITS).cast("long"), n.cast("long"))) & (point > -6)
        short = F.when(e >= 0, F.concat(d, F.repeat(F.lit("0"), F.greatest(e, F.lit(0)).cast("int")))).when(point > 0, F.concat(F.substring(d, F.lit(1), point.cast("int")), F.lit("."), F.substring(d, (point + 1).cast("int"), n))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0)).cast("int")), d))
        long = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(point > 0, F.lit("+")).otherwise(""), (point - 1).cast("string"))
        sign = F.when(F.startswith(token, F.lit("-")), F.lit("-")).otherwise("")
        led = F.when(d == "", F.lit(_INTEGER + "0")).otherwise(F.concat(F.when(e >= 0, F.lit(_INTEGER)).otherwise(F.lit(_NUMBER)), sign, F.when(plain, short).otherwise(long)))
        return F.when(e.isNotNull() | (d == ""), led)

    return F.get(F.transform(F.array(F.struct(digits.alias("d"), scale.alias("e"))), form), F.lit(0))


def _parsed(arguments: Column) -> Column:
    """Arguments as a variant whose numbers are marked strings, so that no digit is lost; null if they are no JSON."""
    mark = _MARK.encode("unicode_escape").decode().replace("\\x01", "\\u0001")

    def marked(t: Column) -> Column:
        number = F.concat(F.lit('"' + mark), F.substring(canonical_number(t), 2, 1 << 30), F.lit('"'))
        string = F.when(F.startswith(t, F.lit('"' + mark)), F.concat(F.lit('"' + mark + "s"), F.substring(t, 2, 1 << 30))).otherwise(t)
        return F.when(F.startswith(t, F.lit('"')), string).when(t.rlike("^-?[0-9]"), number).otherwise(t)

    tokens = F.regexp_extract_all(arguments, F.lit(_TOKEN), F.lit(0))
    all_known = F.forall(tokens, lambda t: marked(t).isNotNull())
    return F.when(all_known, F.try_parse_json(F.array_join(F.transform(tokens, marked), "")))


def _written(parsed: Column) -> Column:
    """Canonical JSON of what ``_parsed`` gave."""
    numbers = F.regexp_replace(F.to_json(parsed), r'"\\u0001[in]([^"]*)"', "$1")
    return F.regexp_replace(numbers, r'"\\u0001s', '"')


def arguments_valid(arguments: Column, schema: Schema) -> Column:
    """Whether a JSON object has the required fields of ``schema`` (name, type, required), of their types, and no others.

    A number is an integer if its value is one, however it is written.
    """
    parsed = _parsed(arguments)
    got = F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), F.try_variant_get(parsed, "$", "map<string,variant>"))
    checks = got.isNotNull()
    led = {"integer": [_INTEGER], "number": [_INTEGER, _NUMBER]}
    for field, kind, required in schema:
        value = F.try_element_at(got, F.lit(field))
        text = F.try_variant_get(value, "$", "string")
        number = reduce(Column.__or__, [F.startswith(text, F.lit(m)) for m in led.get(kind, [_INTEGER, _NUMBER])])
        of_kind = F.schema_of_variant(value).rlike(f"^(?:{TYPE_PATTERNS[kind]})$") & (number if kind in led else ~number if kind == "string" else F.lit(True))
        fits = F.coalesce(of_kind, F.lit(False))
        checks = checks & (fits if required else fits | ~F.map_contains_key(got, field))
    known = F.array(*[F.lit(f) for f, _, _ in schema]).cast("array<string>")
    return F.coalesce(checks & (F.size(F.array_except(F.map_keys(got), known)) == 0), F.lit(False))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _strings(arguments: Column) -> Column:
    """The strings among an object's values and in lists of its values: what may name another call."""
    values = F.map_values(F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>"))
    one = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.try_variant_get(v, "$", "array<string>"))
    lists = F.transform(values, lambda v: F.coalesce(one(v), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.coalesce(lists, F.array().cast("array<array<string>>"))))


def _moved(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """conv_id, call_id, rank, ordered of the calls that depend on others.

    ``calls``: conv_id, call_id, arguments; ``ends``: conv_id, call_id, called (the call's turn). A dependency asks
    for a rank of at least ``least``, and of ``more`` above that of the call that is needed. In each round a dependency on a
    settled call becomes a number; one on a call that has a single dependency left is handed on to what that one needs, so
    chains shorten by half in each round. What is handed on more often than there are calls is in a ring or behind one.
    """
    at = ["conv_id", "call_id"]
    longest = ends.agg(F.max(F.length("call_id"))).first()[0] or 0  # longer strings name no call
    needs = calls.select(*at, F.explode(_strings(F.col("arguments"))).alias("needs")).where((F.length("needs") <= longest) & (F.col("needs") != F.col("call_id"))).distinct()
    known = ends.select("conv_id", F.col("call_id").alias("needs"))
    # a result's rank is its call's and one; who needs it comes behind
    edges = needs.join(known.hint("shuffle_hash"), ["conv_id", "needs"]).select(*at, "needs", F.lit(0).cast("long").alias("least"), F.lit(2).cast("long").alias("more"))
    edges = _shared.cut(edges)
    own = ends.select(*at, (2 * F.col("called")).cast("long").alias("rank"))
    waiting = edges.select(*at).distinct()
    n = waiting.count()
    if not n:
        return own.limit(0).withColumn("ordered", F.lit(True))
    # calls that are needed or wait; the rank of one that waits is what is known of it so far
    state = _shared.cut(own.join(edges.select(*at).union(edges.select("conv_id", F.col("needs").alias("call_id"))).distinct().hint("shuffle_hash"), at))
    while True:
        left = edges.groupBy(*at).agg(F.count("*").alias("open"), F.first("needs").alias("next"), F.first("least").alias("next_least"), F.first("more").alias("next_more"))
        target = state.join(left, at, "left").select("conv_id", F.col("call_id").alias("needs"), F.col("rank").alias("needs_rank"), F.coalesce("open", F.lit(0)).alias("open"), "next", "next_least", "next_more")
        met = edges.join(target, ["conv_id", "needs"])
        settled, handed = F.col("open") == 0, (F.col("open") == 1) & (F.col("more") <= 2 * n)
        reached = F.greatest("least", F.col("needs_rank") + F.col("more"), F.when(handed, F.col("next_least") + F.col("more")))
        met = met.select(*at, settled.alias("settled"), handed.alias("handed"), F.when(handed, F.col("next")).otherwise(F.col("needs")).alias("needs"), reached.alias("least"), (F.col("more") + F.when(handed, F.col("next_more")).otherwise(0)).alias("more"))
        met = _shared.cut(met)
        reach = met.groupBy(*at).agg(F.max("least").alias("reach"))
        state = _shared.cut(state.join(reach, at, "left").select(*at, F.greatest("rank", "reach").alias("rank")))
        moved = met.agg(F.count_if(F.col("settled")), F.count_if(F.col("handed")), F.count_if(~F.col("settled"))).first()
        edges = _shared.cut(met.where("NOT settled").groupBy(*at, "needs").agg(F.max("least").alias("least"), F.max("more").alias("more")))
        if not moved[2] or not (moved[0] or moved[1]):
            break
    unsettled = edges.select(*at).distinct().withColumn("stuck", F.lit(True))
    both = waiting.join(state, at).join(unsettled, at, "left").join(own.withColumnRenamed("rank", "own"), at)
    return both.select(*at, F.when(F.col("stuck"), F.col("own")).otherwise(F.col("rank")).alias("rank"), F.col("stuck").isNull().alias("ordered"))


def link_calls(messages: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """``messages`` with rank, linked, valid, ordered, message and canonical_arguments.

    ``messages`` has conv_id, turn, role, content, kind (``call``, ``result`` or ``message``),
    call_id, name and arguments. ``schemas`` maps a call's name to its fields; a call of an
    unknown name is not valid. Columns called as what is added are replaced, columns of any
    other names are kept. ``canonical_arguments`` is null where they are no JSON.
    """
    keep = _shared.others(messages, ["rank", "linked", "valid", "ordered", "message", "canonical_arguments"])
    used = ["conv_id", "turn", "role", "content", "kind", "call_id", "name", "arguments"]
    names = [F.when(F.col("name") == n, arguments_valid(F.col("arguments"), s)) for n, s in schemas.items()]
    valid = F.when(F.col("kind") == "call", F.coalesce(*names, F.lit(False)))
    m = messages.select(*used, _shared.packed([c for c in keep if c not in used]).alias("row"), valid.alias("valid"))
    keyed = m.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    # both sides shrink to one narrow row per identifier before they meet
    ends = (
        keyed.groupBy("conv_id", "call_id")
        .agg(F.min(F.when(F.col("kind") == "call", F.col("turn"))).alias("called"), F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("answered"), F.min("valid").alias("good"))
        .where(F.col("called").isNotNull())
    )
    ends = _shared.cut(ends)
    moved = _moved(keyed.where("kind = 'call'").select("conv_id", "call_id", "arguments"), ends)
    ends = ends.join(moved, ["conv_id", "call_id"], "left").select(F.col("conv_id").alias("end_conv"), F.col("call_id").alias("end_call"), "called", "answered", "good", F.coalesce("rank", 2 * F.col("called")).alias("call_rank"), F.coalesce("ordered", F.lit(True)).alias("in_order"))
    # messages without an identifier are spread over all tasks
    spread = F.coalesce("call_id", F.concat(F.lit("\0"), F.xxhash64("conv_id", "turn", "content").cast("string")))
    j = m.withColumn("key", spread).join(ends.hint("shuffle_hash"), (F.col("conv_id") == F.col("end_conv")) & (F.col("key") == F.col("end_call")) & F.col("call_id").isNotNull(), "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    both = F.col("called").isNotNull() & F.col("answered").isNotNull()
    linked = F.when(F.col("kind") != "message", both)
    ok = F.when(call, F.col("valid")).when(result, F.when(both, F.col("good")))
    rank = F.when(result & F.col("called").isNotNull(), F.col("call_rank") + 1).when(call & (F.col("turn") == F.col("called")), F.col("call_rank")).otherwise(2 * F.col("turn"))
    canonical = F.when(call, _written(_parsed(F.col("arguments"))))
    body = canonical_json(
        role=F.when(result, F.lit("tool")).otherwise(F.col("role")),
        content=F.when(F.col("kind") != "call", F.col("content")),
        call_id=F.col("call_id"),
        name=F.when(call, F.col("name")),
        arguments=F.when(call, F.coalesce("canonical_arguments", "arguments")),
    )
    extra = [c for c in keep if c not in used]
    own = dict(zip(extra, _shared.unpacked(extra), strict=True))
    done = {"rank": rank.cast("long"), "linked": linked, "valid": ok, "ordered": F.when(call | result, F.coalesce("in_order", F.lit(True))), "message": body, "canonical_arguments": F.col("canonical_arguments")}
    return j.withColumn("canonical_arguments", canonical).select(*[own.get(c, _shared.column(c)) for c in keep], *[v.alias(k) for k, v in done.items()])


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Plain turns as calls and results: what a user asks is a call, the assistant's next turn its result.

    The identifier of a call is its conversation and turn; an assistant's turn answers the turn before it.
    """
    asked = F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    arguments = canonical_json(length=F.length("text"), text=F.col("text"))
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("content"),
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("role").isNotNull(), kind).otherwise("message").alias("kind"),
        F.concat_ws(":", F.col("conv_id").cast("string"), asked.cast("string")).alias("_id"),
        asked.alias("_asked"),
        F.when(F.col("role") == "user", F.lit("ask")).alias("name"),
        F.when(F.col("role") == "user", arguments).alias("arguments"),
    ).select("conv_id", "turn", "role", "content", "kind", F.when((F.col("kind") != "message") & F.col("_asked").isNotNull(), F.col("_id")).alias("call_id"), "name", "arguments")


#: What a plain question must look like.
ASK: dict[str, Schema] = {"ask": [("length", "integer", True), ("text", "string", True)]}
