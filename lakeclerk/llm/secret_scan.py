"""Secrets found through an inverted index of trigrams (operator 7).

Each rule is a regular expression. The trigrams that its matches must hold form
a Boolean query. Postings of the trigrams that any query names are built from
all texts; a rule's postings are intersected by document, and the expression
runs on the documents that are left. Rules without a mandatory trigram run on
all. Everything is built-in functions: no Python sees a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.trigrams import ALWAYS, trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Shorter runs of hexadecimal digits fail, so they need not be matched.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def postings(documents: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """(trigram, key) for every named trigram in the lower case of every text."""
    lower = documents.select(documents[key].alias("key"), F.lower(documents[text]).alias("low"))
    found = [F.when(F.contains("low", F.lit(gram)), F.lit(gram)) for gram in trigrams]
    return lower.select("key", F.explode(F.array_compact(F.array(*found))).alias("trigram"))


def candidates(documents: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """(key, rules): which rules with a trigram query may match in a document.

    The texts of one key, if it repeats, count as one. The work on a key is a
    set of bits, reduced in each task before the shuffle.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    trigrams = sorted({g for q in queries.values() for clause in q for g in clause})
    wanted = [
        (rule.kind, number, gram, 1 << place, (1 << len(clause)) - 1)
        for rule in rules
        for number, clause in enumerate(sorted(queries[rule.kind], key=sorted))
        for place, gram in enumerate(sorted(clause))
    ]
    # The table of queries is of fixed size, so it is a map in the plan.
    places = {}
    for kind, number, gram, bit, need in wanted:
        places.setdefault(gram, []).append((kind, number, bit, need))
    uses = F.create_map(
        *[
            x
            for gram, rows in places.items()
            for x in (
                F.lit(gram),
                F.array(
                    *[
                        F.struct(
                            F.lit(kind).alias("kind"),
                            F.lit(number).alias("clause"),
                            F.lit(bit).cast("long").alias("bit"),
                            F.lit(need).cast("long").alias("need"),
                        )
                        for kind, number, bit, need in rows
                    ]
                ),
            )
        ]
    )
    return (
        postings(documents, trigrams, key, text)
        .select("key", F.explode(uses[F.col("trigram")]).alias("use"))
        .groupBy("key", "use.kind", "use.clause", "use.need")
        .agg(F.bit_or("use.bit").alias("bits"))
        .where(F.col("bits") == F.col("need"))
        .groupBy("key")
        .agg(F.collect_set("kind").alias("rules"))
    )


def _spans(kind_place: int, text: Column, whole: Column, group: Column, rule: Rule) -> Column:
    """Begin, place of the kind and end of the matches, in code points.

    The matches and what stands between them alternate, so their lengths add
    up to the offsets.
    """
    between = F.split(text, rule.pattern, -1)
    lengths = F.transform(
        F.arrays_zip(
            F.transform(F.slice(between, F.lit(1), F.size(whole)), F.length).alias("gap"),
            F.transform(whole, F.length).alias("size"),
            F.transform(group, F.length).alias("judged"),
        ),
        lambda x: x,
    )
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<begin:int,kind:int,end:int>>").alias("found"),
    )

    def step(state: Column, match: Column) -> Column:
        begin = state["at"] + match["gap"]
        end = begin + match["size"]
        span = F.struct(
            begin.alias("begin"), F.lit(kind_place).alias("kind"), end.alias("end")
        )
        return F.struct(
            end.alias("at"),
            F.when(match["judged"] >= rule.least, F.concat(state["found"], F.array(span)))
            .otherwise(state["found"])
            .alias("found"),
        )

    return F.when(
        F.size(whole) > 0, F.aggregate(lengths, start, step, lambda state: state["found"])
    ).otherwise(start["found"])


def find_secrets(
    documents: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    key: str = "doc_id",
    text: str = "text",
    into: str = "secrets",
) -> DataFrame:
    """All columns of ``documents`` and ``into``, sorted spans of all rules.

    A span is ``begin``, ``kind`` (the place of its rule) and ``end``, in code
    points, end exclusive. Matches of one rule do not overlap; those of several
    may. A null or empty text has none. A key may repeat; rows without a key
    are in no posting, so all rules run on them. A column that has the name of
    ``into`` already is replaced.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = tuple(rule for rule in rules if queries[rule.kind] != ALWAYS)
    rows = documents
    if indexed:
        found = candidates(documents, indexed, key, text).withColumnsRenamed(
            {"key": "__secret_key", "rules": "__secret_rules"}
        )
        rows = rows.join(found, rows[key] == found["__secret_key"], "left").drop("__secret_key")
    else:
        rows = rows.withColumn("__secret_rules", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("__secret_text", F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<string>")
    matches, spans = {}, []
    for place, rule in enumerate(rules):
        may = F.col(key).isNull() | F.array_contains("__secret_rules", rule.kind)
        for group in {0, rule.group}:
            every = F.regexp_extract_all("__secret_text", F.lit(rule.pattern), F.lit(group))
            matches[f"__secret_{place}_{group}"] = (
                F.when(may, every).otherwise(none) if rule in indexed else every
            )
        spans.append(
            _spans(
                place, F.col("__secret_text"), F.col(f"__secret_{place}_0"), F.col(f"__secret_{place}_{rule.group}"), rule
            )
        )
    rows = rows.withColumns(matches)
    return rows.withColumn(into, F.array_sort(F.concat(*spans))).drop(
        "__secret_text", "__secret_rules", *matches
    )


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:begin:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["begin"], s["end"])
        ),
        ",",
    )


def secret_digests(documents: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document, as operator 7 returns them."""
    found = find_secrets(documents.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE_RULES))

    def count(place: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == place)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE_RULES)],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )


def redact(documents: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``documents`` with every secret replaced by ``mark``; spans that overlap by one."""
    spans = "__secret_spans"
    found = find_secrets(documents, text=text, into=spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def step(state: Column, span: Column) -> Column:
        new = span["begin"] >= state["at"]
        plain = F.substring(F.col(text), state["at"] + 1, span["begin"] - state["at"])
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(new, F.concat(state["kept"], plain, F.lit(mark)))
            .otherwise(state["kept"])
            .alias("kept"),
        )

    def rest(state: Column) -> Column:
        tail = F.substring(F.col(text), state["at"] + 1, F.length(F.col(text)))
        return F.concat(state["kept"], tail)

    return found.withColumn(
        text,
        F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(
            F.col(text)
        ),
    ).drop(spans)
