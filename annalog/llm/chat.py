"""Chat formatting of typed content parts, in SQL functions only.

A message is a role and a list of parts: text, image, audio or document. A visitor over
the parts (one ``CASE`` a kind, inside ``transform``) flattens them in order: text as
its escaped self, any other part as a placeholder, with its reference and the number
of tokens the placeholder will be expanded to recorded as an attachment.

The template is ``<|im_start|>role\\n...<|im_end|>\\n`` a message. In roles and texts a
backslash is doubled, ``<|`` becomes ``<\\|``, a bar that begins a part after the first
becomes ``\\|``, and in roles a line break becomes ``\\n``; so control strings can't be
forged, not by parts side by side either, and undoing the escapes gives each text back.
Reading a formatted conversation back yields its messages, and the loss mask: the
text of ``assistant`` messages.

A conversation is one output row, so its turns meet in one task by nature; turns are
escaped before they are grouped. Null roles and texts are empty. Null turns come
first; repeated turns are kept, ordered by turn, role and text. A null ``conv_id`` is a
conversation of its own. A part of unknown kind, or null, is an empty text. Very long texts
are formatted whole; a conversation must fit into one row.
Extra columns play no part. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens a placeholder stands for: a patch of an image, a second of audio, a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256


def escape(text: Column) -> Column:
    """Text without any ``<|``, reversibly."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a pair is read from the left: \\ is a backslash, \| a bar, \n a line break
    marked = F.regexp_replace(role, r"\\(.)", "\\\\$1\u0000")
    return F.replace(F.replace(F.replace(marked, F.lit("\\n\u0000"), F.lit("\n")), F.lit("\\|\u0000"), F.lit("|")), F.lit("\\\\\u0000"), F.lit("\\"))


def _visit(part: Column, i: Column) -> Column:
    """(rendered, attachment) of part ``i``; attachment is null for text."""
    kind = part["kind"]
    text = F.coalesce(part["text"], F.lit(""))
    # a bar that begins a later part would make a control string of a < before it
    said = F.concat(F.when((i > 0) & F.startswith(text, F.lit("|")), F.lit("\\")).otherwise(F.lit("")), escape(text))
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND)
    pages = F.coalesce(part["pages"], F.lit(0)) * PER_PAGE
    tokens = F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", pages).cast("long")
    attached = kind.isin("image", "audio", "document")
    rendered = F.when(attached, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(said)
    return F.struct(rendered.alias("rendered"), F.when(attached, F.struct(kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("n_tokens"))).alias("attachment"))


def flatten(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, parts) with ``content`` and ``attachments`` for parts."""
    seen = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), _visit)
    out = messages.withColumn("_seen", seen)
    return out.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform("_seen", lambda x: x["rendered"]), "").alias("content"),
        F.filter(F.transform("_seen", lambda x: x["attachment"]), lambda a: a.isNotNull()).alias("attachments"),
    )


def text_messages(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as messages of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("kind"), F.col("text"), *[F.lit(None).cast(t).alias(k) for k, t in none.items()])
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, attachments, n_attachment_tokens) for each conversation."""
    flat = flatten(messages)
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), F.col("content"), F.lit(END))
    each = flat.select("conv_id", F.struct("turn", "role", turn.alias("said"), "attachments").alias("m"))
    chats = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    attachments = F.flatten(F.transform("ms", lambda m: m["attachments"]))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("ms", lambda m: m["said"]), "").alias("formatted"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("n_attachment_tokens"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns``: the (role, text) pairs read back from ``formatted``.

    Placeholders stay in the text of a message that has attachments.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def one(block: Column) -> Column:
        body = F.substr(block, F.lit(len(START) + 1))
        cut = F.locate("\n", body)
        return F.struct(unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return chats.withColumn("turns", F.transform(blocks, one))


def loss_text(turns: str = "turns") -> Column:
    """All text under the loss mask: assistant texts, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation, from its formatted text; and its attachments, in order."""
    back = read_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss_text()).cast("long").alias("loss_chars"), F.sha2(loss_text(), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "n_attachment_tokens",
        F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["kind"], a["ref"])), ",").alias("attachment_refs"),
    )
