"""Chat formatting with typed content parts (DataFrame functions only).

A turn's content is an array of parts, each a struct with ``kind`` (text, image, audio or document) and the
fields of ``PART``. A visitor (one branch for each kind, applied by ``transform``) flattens the parts in order:

* text becomes its escaped text;
* image, audio and document parts become numbered placeholders ``<|image:0|>``; the part's reference is
  recorded as an attachment with its ordinal and the number of tokens the placeholder expands to.

The template is ``<|turn|>role<|text|>content<|end|>``, turn after turn. Control strings inside roles and texts
are made harmless by putting a backslash into them, and backslashes are doubled, so that dropping each escaping
backslash gives the text back. ``<|`` in the output is thus always the template's own.

Defined results: null text, role or reference counts as empty; null parts give an empty content; turns are
ordered by turn (nulls first), then role, then content; repeated rows are kept; rows without conversation id form
one conversation of their own; unknown kinds count as text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, each cut after its first character when escaped.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]"]
_CUT = r"(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])|(?=\\)"


def escape(c: Column) -> Column:
    """Cut every control string and double every backslash."""
    return F.regexp_replace(c, F.lit(_CUT), F.lit("\\\\"))


def unescape(c: Column) -> Column:
    """The inverse of ``escape``: a backslash stands for the character after it."""
    return F.regexp_replace(c, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def text_part(c: Column) -> Column:
    """A plain text as an array of one typed part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(c, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def part_tokens(p: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """The number of tokens a part's placeholder expands to (0 for text)."""
    zero = F.lit(0)
    return (
        F.when(
            p["kind"] == "image",
            F.ceil(F.coalesce(p["width"], zero) / patch) * F.ceil(F.coalesce(p["height"], zero) / patch),
        )
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * audio_rate))
        .when(p["kind"] == "document", F.coalesce(p["pages"], zero) * page_tokens)
        .otherwise(zero)
        .cast("long")
    )


def _is_media(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")).isin("image", "audio", "document")


def format_chat(
    turns: DataFrame, *, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256
) -> DataFrame:
    """One row for each conversation from rows ``conv_id, turn, role, parts array<PART>``.

    Returns conv_id, formatted, attachments (ordinal, kind, ref, n_tokens), n_media_tokens and loss_mask: the
    half-open code-point spans of ``formatted`` that hold assistant text, placeholders excluded.
    """
    row = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    convs = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("row")).alias("rows")
    )
    # One entry for each part, with its turn's head before the first and its turn's end after the last.
    empty = F.lit(None).cast(PART)
    entries = F.flatten(
        F.transform(
            "rows",
            lambda r: F.transform(
                F.concat(r["parts"], F.array(empty)),
                lambda p, i: F.struct(
                    F.when(i == 0, F.concat(F.lit(TURN), escape(r["role"]), F.lit(TEXT))).otherwise("").alias("head"),
                    p.alias("part"),
                    (i == F.size(r["parts"])).alias("last"),
                    (i > 0).alias("joined"),
                    (r["role"] == "assistant").alias("loss"),
                ),
            ),
        )
    )
    # Ordinals and offsets are running sums over a conversation's parts, in one sort of its rows.
    each = convs.select("conv_id", F.posexplode(entries).alias("at", "e")).select("conv_id", "at", "e.*")
    media = ~F.col("last") & _is_media(F.col("part"))
    upto = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = escape(F.coalesce(F.col("part.text"), F.lit("")))
    # Two parts must not form a control string together.
    text = F.when(F.col("joined") & text.rlike(r"^[^\\\\]"), F.concat(F.lit("\\"), text)).otherwise(text)
    ordinal = (F.col("upto") - 1).cast("int")
    body = (
        F.when(F.col("last"), F.lit(END))
        .when(F.col("media"), F.concat(F.lit("<|"), F.col("part.kind"), F.lit(":"), ordinal.cast("string"), F.lit("|>")))
        .otherwise(text)
    )
    each = each.withColumn("media", media).withColumn("upto", F.sum(F.col("media").cast("int")).over(upto)).withColumn("body", body)
    each = each.withColumn("stop", F.sum(F.length("head") + F.length("body")).over(upto).cast("int"))
    token_count = F.when(F.col("media"), part_tokens(F.col("part"), patch, audio_rate, page_tokens))
    attached = F.struct(
        ordinal.alias("ordinal"), F.col("part.kind").alias("kind"), F.coalesce("part.ref", F.lit("")).alias("ref"), token_count.alias("n_tokens")
    )
    keep = F.col("loss") & ~F.col("last") & ~F.col("media") & (F.length("body") > 0)
    row = F.struct(
        "at", F.concat("head", "body").alias("piece"),
        F.when(F.col("media"), attached).alias("attached"),
        F.when(keep, F.struct((F.col("stop") - F.length("body")).alias("start"), F.col("stop").alias("end"))).alias("mask"),
    )
    rows = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.array_compact(F.transform("rows", lambda r: r["attached"])).alias("attachments"),
        F.array_compact(F.transform("rows", lambda r: r["mask"])).alias("loss_mask"),
    ).withColumn("n_media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"])).select(
        "conv_id", "formatted", "attachments", "loss_mask", "n_media_tokens"
    )


def parse_chat(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text), unescaped, placeholders left in the text."""
    cut = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))),
        lambda t: F.struct(
            unescape(F.substring_index(t, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(t, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )
