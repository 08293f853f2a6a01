"""Uploaded payloads: rows of ``(upload_seq, name, data_uri)`` become inventory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import labels
from kinfold.functions import text
from kinfold.sources.inventory import describe, drop_excluded, in_excluded
from kinfold.sources.scratch import materialize

# All but A-Z a-z 0-9 + / =, as ranges: Java takes many times as long over the same class negated.
_FOREIGN = r"[\x00-\x2A\x2C-\x2E\x3A-\x3C\x3E-\x40\x5B-\x60\x7B-\x{10FFFF}]+"


def decode_base64(encoded: Column) -> Column:
    """Lenient base64 as an array with the binary, empty if the padding is wrong.

    Characters outside the alphabet are skipped. Decoding stops at the first padding that completes a group of
    four; a ``=`` at any other place is skipped. The text is cut at every ``=`` and the pieces are folded. The
    result is an array so that the folded state is bound once and ``explode`` drops what cannot be decoded.
    """

    def step(state: Column, piece: Column) -> Column:
        open_chars = F.length(state["data"]) % 4
        pads = F.when(open_chars >= 2, state["pads"] + 1).otherwise(F.lit(0))
        done = state["done"] | ((open_chars >= 2) & (open_chars + pads >= 4))
        return F.struct(
            F.when(done, state["data"]).otherwise(F.concat(state["data"], piece)).alias("data"),
            F.when(piece == "", pads).otherwise(F.lit(0)).alias("pads"),
            done.alias("done"),
        )

    def fold(pieces: Column) -> Column:
        start = F.struct(F.element_at(pieces, 1).alias("data"), F.lit(0).alias("pads"), F.lit(False).alias("done"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step)

    def binary(end: Column) -> Column:
        length = F.length(end["data"])
        padded = F.rpad(end["data"], (F.ceil(length / 4) * 4).cast("int"), F.lit("="))
        return F.when(end["done"] | (length % 4 == 0), F.try_to_binary(padded, F.lit("base64")))

    pieces = F.array(F.split(F.regexp_replace(encoded, _FOREIGN, ""), "="))
    return F.filter(F.transform(F.transform(pieces, fold), binary), lambda content: content.isNotNull())


def _texts(payloads: DataFrame) -> DataFrame:
    """``(seq, path, has_data, _text)``: what follows the comma, without the characters that a decoder skips.

    Encoders break lines every 76 characters; their ends go by a plain replacement before the expression is tried.
    """
    comma = F.instr("data_uri", ",")
    unbroken = F.replace(F.substr("data_uri", comma + 1), F.lit("\r\n"))
    return payloads.select(
        F.col("upload_seq").alias("seq"),
        text.forward_slashes(F.col("name")).alias("path"),
        F.coalesce(comma > 0, F.lit(False)).alias("has_data"),
        F.when(comma > 0, F.regexp_replace(unbroken, _FOREIGN, "")).alias("_text"),
    )


def _contents() -> Column:
    """The content of a ``_text`` as an array, empty if it cannot be decoded and null without data.

    Ordinary base64, with padding only at its end, is decoded at once; only other texts are folded piece by piece. To be
    exploded where it is made: of a column of its own Spark would also ask the size, in a filter that decodes once more.
    """
    ordinary = (F.length("_text") % 4 == 0) & F.col("_text").rlike("^[^=]*={0,2}$")
    contents = F.when(ordinary, F.array(F.unbase64("_text"))).otherwise(decode_base64(F.col("_text")))
    return F.when(F.col("has_data"), contents)


def decoded_payloads(payloads: DataFrame) -> DataFrame:
    """Decodable payloads as ``(seq, path, content)``."""
    return _texts(payloads).select("seq", "path", F.explode(_contents()).alias("content"))


def _hashes() -> list[Column]:
    return [F.octet_length("content").cast("long").alias("size_bytes"), F.md5("content").alias("content_md5")]


def payload_files(payloads: DataFrame) -> DataFrame:
    """``(seq, path, size_bytes, content_md5)``; of one name the last upload stays, of equal numbers the largest content.

    Contents are hashed where they are decoded, so only their hashes are shuffled.
    """
    hashed = decoded_payloads(payloads).select("seq", "path", *_hashes())
    last = F.max(F.struct("seq", "size_bytes", "content_md5"))
    return hashed.groupBy("path").agg(last.alias("last")).select("path", "last.*")


def payload_outcomes(payloads: DataFrame) -> DataFrame:
    """Every upload once, ``(seq, path, size_bytes, content_md5, reason)``; accepted ones have no reason.

    Uploads are decoded once, into a table without contents. Of one name the last decodable upload is accepted, as in
    ``payload_files``; of equal rows, one. The first reason that holds is told.
    """
    decoded = _texts(payloads).select("seq", "path", "has_data", F.explode_outer(_contents()).alias("content"))
    lost = (
        F.when(F.col("path").isNull(), labels.NO_NAME)
        .when(in_excluded(F.col("path")), labels.EXCLUDED)
        .when(~F.col("has_data"), labels.NO_DATA)
        .when(F.col("content").isNull(), labels.NOT_DECODABLE)
    )
    judged = decoded.select("seq", "path", *_hashes(), lost.alias("reason"), F.monotonically_increasing_id().alias("_row"))
    judged = materialize(judged, "judged-payloads")
    # A name may be that of many uploads: it is aggregated, and joined back by row.
    place = F.max(F.struct("seq", "size_bytes", "content_md5", "_row"))["_row"]
    last = judged.filter("reason IS NULL").groupBy("path").agg(place.alias("_row"))
    kept = judged.join(last.select("_row", F.lit(True).alias("_last")), "_row", "left")
    replaced = F.when(F.col("_last").isNull(), labels.REPLACED)
    return kept.select("seq", "path", "size_bytes", "content_md5", F.coalesce("reason", replaced).alias("reason"))


def payload_inventory(payloads: DataFrame, received_at: str) -> DataFrame:
    """The files exist since the upload, so both dates are ``received_at``. Excluded directories are left out, as in a
    folder scan; an upload without any payload is an error."""
    if payloads.isEmpty():
        raise ValueError("the upload is empty")
    return _inventory(drop_excluded(payload_files(payloads)), received_at)


def accepted_payloads(outcomes: DataFrame, received_at: str) -> DataFrame:
    """The inventory of ``payload_inventory`` from the outcomes of the same uploads."""
    return _inventory(outcomes.filter("reason IS NULL"), received_at)


def rejected_payloads(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("reason IS NOT NULL").select("seq", "path", "reason")


def _inventory(files: DataFrame, received_at: str) -> DataFrame:
    return describe(
        files.select(
            "seq",
            "path",
            "size_bytes",
            "content_md5",
            F.lit(received_at).alias("created_at_raw"),
            F.lit(received_at).alias("modified_at_raw"),
        )
    )
