"""String renderings: meta-token strings and policy prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The few-shot policy prompt template and its reply labels.
PROMPT_TEMPLATE = (
    "Label with any of: Advertisement/Promo, Irrelevant Content, Rant (Likely Non-Visitor), Spam/Low-quality, None. "
    "If review is not in English, produce an English translation that preserves tone/meaning. "
    "If images are provided, briefly judge whether they match the location context. "
    "Return JSON with fields: labels[], relevance (0–1), image_relevance (0–1, omit if no images), "
    "language (ISO-ish), normalized_text (possibly translated), rationale.\n"
    "Place: {place}\nReview: \"{text}\"\nImages (optional URLs): {images}\n"
)
REPLY_SCHEMA = ("labels ARRAY<STRING>, relevance DOUBLE, image_relevance DOUBLE, language STRING, "
                "normalized_text STRING, rationale STRING")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def two_places(c: Column) -> Column:
    """A non-negative double with two decimals, rounded on its exact binary
    value, ties to even (``%.2f`` of C); NULL stays NULL.

    ``100 * x`` is split into a rounded product and its exact error (Dekker), so
    the comparison with one half sees the true value."""
    x = c.cast("double")
    big = x * 134217729.0
    high = big - (big - x)
    product = x * 100.0
    error = (high * 100.0 - product) + (x - high) * 100.0
    whole = F.floor(product)
    over = product - whole.cast("double")
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%02d", F.floor(n / 100).cast("bigint"), (n % 100).cast("bigint"))


def plain_double(c: Column) -> Column:
    """A non-negative double in its shortest form, the way Python prints it
    below 1e16: no exponent from 1e-4 on, ``1e-05`` style below."""
    s = c.cast("double").cast("string")
    digits = F.regexp_replace(F.regexp_extract(s, "^([0-9.]+)E", 1), "\\.0$", "")
    power = F.regexp_extract(s, "E(-?[0-9]+)$", 1).try_cast("int")
    bare = F.replace(digits, F.lit("."), F.lit(""))
    small = F.when(power >= -4, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), bare)).otherwise(
        F.concat(digits, F.lit("e-"), F.lpad((-power).cast("string"), 2, "0")))
    large = F.concat(F.rpad(bare, power + 1, "0"), F.lit(".0"))
    split = F.concat(F.substring(bare, F.lit(1), power + 1), F.lit("."), F.substring(bare, power + 2, F.length(bare)))
    return F.when(power.isNull(), s).when(power < 0, small).when(F.length(bare) > power + 1, split).otherwise(large)


def meta_tokens(df_cols: dict[str, Column] | None = None) -> Column:
    """``meta: url=.. len=.. caps=%.2f emoji=.. uname_gib=%.2f imgs=.. burst24=..
    dup=.. ent=%.2f prof=.. dist=..`` from the feature columns."""
    c = df_cols or {}

    def col(name: str, default) -> Column:
        return F.coalesce(c.get(name, F.col(name)), F.lit(default))

    def whole(name: str, default) -> Column:
        return col(name, default).cast("int")

    return F.format_string(
        "meta: url=%d len=%d caps=%s emoji=%d uname_gib=%s imgs=%d burst24=%d dup=%d ent=%s prof=%d dist=%s",
        whole("has_url", False), whole("char_len", 0), two_places(col("caps_ratio", 0.0)), whole("emoji_count", 0),
        two_places(col("user_name_gibberish", 0.0)), whole("image_count", 0), whole("user_burst_24h", 0),
        whole("dup_across_places", False), two_places(col("char_entropy", 0.0)), whole("profanity_count", 0),
        F.coalesce(plain_double(F.col("distance_km")), F.lit("nan")),
    )


def render_prompt(place: Column | str, text: Column | str, images: Column | str) -> Column:
    """Fill {place}, {text}, {images} of the template (one pass per slot)."""
    t = F.lit(PROMPT_TEMPLATE)
    t = F.replace(t, F.lit("{place}"), F.coalesce(_c(place), F.lit("")))
    t = F.replace(t, F.lit("{images}"), F.coalesce(_c(images), F.lit("[]")))
    return F.replace(t, F.lit("{text}"), F.coalesce(_c(text), F.lit("")))


def parse_reply(col: Column | str) -> Column:
    """Model reply JSON object -> struct (labels[], relevance, ...); NULL if the
    text is not JSON or not an object."""
    reply = _c(col)
    valid = F.try_parse_json(reply).isNotNull() & F.json_object_keys(reply).isNotNull()
    return F.when(valid, F.from_json(reply, REPLY_SCHEMA))
