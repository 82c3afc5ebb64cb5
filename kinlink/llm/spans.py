"""Match positions by built-in functions only: (start, end) in code points, leftmost, not overlapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import bound, prefix_sums

SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"


def found(text: Column, kind: int, pattern: str, keep: Callable[[Column], Column] | None = None, needs: str | None = None) -> Column:
    """Spans of ``pattern`` in ``text``. Every match counts for its place; those that ``keep``
    refuses are then dropped, without another try. ``needs``: a literal that any match holds;
    texts without it aren't searched. Null and empty texts give an empty array.

    The text between matches comes from ``split`` by the same pattern, and places are the
    running sums of the lengths."""
    none = F.array().cast(SPAN)

    def placed(hits):
        def at(starts):
            spans = F.transform(
                hits,
                lambda m, i: F.struct(
                    F.lit(kind).alias("kind"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("value")
                ),
            )
            return F.filter(spans, lambda s: keep(s["value"])) if keep else spans

        def starts(gaps):
            steps = F.transform(hits, lambda m, i: (F.length(m) + F.length(F.get(gaps, i + 1))).cast("bigint"))
            return bound(prefix_sums(steps), lambda s: F.transform(s, lambda x: x + F.length(F.get(gaps, F.lit(0)))))

        return F.when(F.size(hits) == 0, none).otherwise(bound(bound(F.split(text, pattern, -1), starts), at).cast(SPAN))

    out = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    some = F.contains(text, F.lit(needs)) if needs else F.length(text) > 0
    return F.when(F.coalesce(some, F.lit(False)), out).otherwise(none)


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of every span, joined by commas, in the order of the array."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redacted(text: Column, spans: Column, kinds: list[str]) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one
    that starts first (then the longest) is replaced and swallows the rest. Null stays null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in kinds])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("k"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        end = -x["b"]
        whole = F.struct(
            end.alias("at"),
            F.concat(s["out"], F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["a"] - s["at"]).cast("int")), F.get(names, x["k"]))).alias("out"),
        )
        longer = F.struct(F.greatest(s["at"], end).alias("at"), s["out"].alias("out"))
        return F.when(x["a"] >= s["at"], whole).otherwise(longer)

    folded = F.aggregate(
        order, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)
