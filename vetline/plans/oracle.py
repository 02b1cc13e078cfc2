"""DuckDB-dialect twins of the Spark expressions, for the SQL oracle.

Each helper returns a SQL expression string over a text expression. They
reuse the regex bodies of :mod:`vetline.functions.patterns` so the Spark
side and the oracle cannot drift apart silently.
"""

from __future__ import annotations

from vetline.config import AD, RANT, SPAM
from vetline.functions import patterns as P


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def txt(col: str = "text") -> str:
    return f"coalesce({col}, '')"


def url_count(t: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, {q(P.url_pattern())})) AS BIGINT)"


def has_url(t: str) -> str:
    return f"regexp_matches({t}, {q(P.url_pattern())})"


def promo(t: str) -> str:
    return f"regexp_matches({t}, {q(P.promo_pattern('duckdb'))})"


def never_been(t: str) -> str:
    return f"regexp_matches({t}, {q(P.never_been_pattern('duckdb'))})"


def repeat_flag(chars: str) -> str:
    """Some character other than a newline repeated 5+ times in a row.
    RE2 has no back-references, so compare windows of the code-point list
    ``chars`` (``string_split(text, '')``, computed once per row)."""
    same = " AND ".join(f"{chars}[i] = {chars}[i + {k}]" for k in range(1, 5))
    return f"(len(list_filter(range(1, len({chars}) - 3), lambda i: {chars}[i] <> chr(10) AND {same})) > 0)"


def with_chars(source: str = "reviews", text: str = "text") -> str:
    """CTE body adding the code-point list of the text."""
    return f"SELECT *, string_split(coalesce({text}, ''), '') AS chars FROM {source}"


def repeat_ratio(chars: str = "chars") -> str:
    return f"CASE WHEN {repeat_flag(chars)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def regexp_count(t: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, {q(pattern)})) AS BIGINT)"


def caps_ratio(t: str) -> str:
    letters = f"len(regexp_extract_all({t}, '\\p{{L}}'))"
    upper = f"len(regexp_extract_all({t}, '\\p{{Lu}}'))"
    return f"CASE WHEN {letters} = 0 THEN 0.0::DOUBLE ELSE {upper}::DOUBLE / {letters} END"


def nonword_ratio(t: str) -> str:
    return f"({regexp_count(t, P.nonword_pattern())}::DOUBLE / greatest(1, length({t})))"


def experiential(t: str) -> str:
    low = f"lower({t})"
    hits = " + ".join(f"CAST(regexp_matches({low}, {q(p)}) AS INTEGER)" for p in P.experiential_patterns())
    return f"least(1.0::DOUBLE, ({hits})::DOUBLE / 4.0::DOUBLE)"


def profanity(t: str, words: tuple[str, ...]) -> str:
    lst = "[" + ", ".join(q(w) for w in words) + "]"
    return (f"CAST(len(list_filter(regexp_extract_all(lower({t}), '[A-Za-z'']+'), "
            f"lambda x: list_contains({lst}, x))) AS BIGINT)")


def weak_labels(t: str, chars: str = "chars") -> str:
    """Labels joined by '|' in canonical order ('' for none)."""
    return (
        f"concat_ws('|', CASE WHEN {has_url(t)} AND {promo(t)} THEN {q(AD)} END, "
        f"CASE WHEN {never_been(t)} THEN {q(RANT)} END, "
        f"CASE WHEN {repeat_flag(chars)} THEN {q(SPAM)} END)"
    )


def trim_ws(t: str) -> str:
    ws = P.ws_class()
    return f"regexp_replace({t}, {q(f'^{ws}+|{ws}+$')}, '', 'g')"


def collapse_ws(t: str) -> str:
    return f"trim(regexp_replace({t}, {q(P.ws_class() + '+')}, ' ', 'g'))"


def strip_tags(t: str) -> str:
    return f"regexp_replace({t}, {q(P.tag_pattern('duckdb'))}, ' ', 'g')"


def basic_unescape(t: str) -> str:
    """The five XML entities only. DuckDB has no full HTML5 unescape and no
    NFKC; the test texts carry no other entity and are NFKC-stable."""
    return (f"replace(replace(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), "
            f"'&quot;', '\"'), '&#39;', ''''), '&amp;', '&')")


def text_norm(t: str) -> str:
    return f"lower({collapse_ws(strip_tags(basic_unescape(t)))})"


def gibberish(name: str) -> str:
    n = trim_ws(f"coalesce({name}, '')")
    core = f"regexp_replace({n}, '[^\\p{{L}}]', '', 'g')"
    n_len, core_len = f"length({n})", f"length({core})"
    vowels = f"len(regexp_extract_all(lower({core}), '[aeiou]'))"
    digits = f"len(regexp_extract_all({n}, {q('[' + P.digit_body() + ']')}))"
    nonalpha = f"len(regexp_extract_all({n}, {q(P.nonword_pattern())}))"
    long_run = f"regexp_matches({core}, {q('(?i)[' + P.CONSONANTS + ']{5,}')})"
    d = "::DOUBLE"
    score = (
        f"((((0.0{d} + CASE WHEN {vowels}{d} / greatest(1, {core_len}) < 0.2{d} THEN 0.4{d} ELSE 0.0{d} END)"
        f" + CASE WHEN {digits}{d} / greatest(1, {n_len}) > 0.3{d} THEN 0.2{d} ELSE 0.0{d} END)"
        f" + CASE WHEN {nonalpha}{d} / greatest(1, {n_len}) > 0.2{d} THEN 0.2{d} ELSE 0.0{d} END)"
        f" + 0.2{d} * CAST({long_run} AS INTEGER))"
    )
    return (f"CASE WHEN {n_len} <= 1 OR {core_len} = 0 THEN 1.0{d} "
            f"ELSE least(1.0{d}, greatest(0.0{d}, {score})) END")


def parse_dt(s: str) -> str:
    from vetline.functions.timegeo import _ZONED

    v = f"trim(CAST({s} AS VARCHAR))"
    return (
        f"CASE WHEN regexp_full_match({v}, '[0-9]+') THEN epoch_ms(TRY_CAST({v} AS BIGINT)) "
        f"WHEN regexp_matches({v}, {q(_ZONED)}) THEN timezone('UTC', TRY_CAST({v} AS TIMESTAMPTZ)) "
        f"ELSE TRY_CAST({v} AS TIMESTAMP) END"
    )


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(6371.0::DOUBLE * (2 * atan2(sqrt({a}), sqrt(greatest(0.0::DOUBLE, 1 - {a})))))"


def parse_pics(s: str) -> str:
    """Same rule as :func:`vetline.functions.pics.parse_pics`."""
    v = trim_ws(s)
    split_parts = (f"list_filter(list_transform(string_split({v}, ';'), lambda x: {trim_ws('x')}), "
                   f"lambda x: x <> '')")
    strings = (f"list_transform(list_filter(json_extract({v}, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), "
               f"lambda x: json_extract_string(x, '$'))")
    return (
        f"CASE WHEN {s} IS NULL OR {v} = '' THEN []::VARCHAR[] "
        f"WHEN json_valid({v}) AND json_type({v}) = 'ARRAY' THEN {strings} "
        f"WHEN json_valid({v}) THEN [{v}] "
        f"WHEN contains({v}, ';') THEN {split_parts} "
        f"ELSE [{v}] END"
    )


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def decision_labels(cfg=None) -> str:
    """Labels ('|'-joined, canonical order) of the decision layer over the
    columns p_ad, p_irr, p_rant, p_spam, relevancy, image_relevancy,
    user_name_gibberish, user_burst_24h, dup_across_places, char_entropy,
    profanity_count, distance_km, never_been_cues, experiential_score."""
    from vetline import config as C

    cfg = cfg or C.ScreenConfig()
    pri, sw, th = cfg.priors, cfg.switches, cfg.thresholds
    d = "::DOUBLE"

    def b(x):
        return f"coalesce({x}, false)"

    irr = b(f"relevancy < {th.rel_thresh}{d} AND coalesce(p_irr, 0{d}) >= {th.irr}{d}")
    if sw.enable_image_relevance:
        irr += " OR " + b(f"image_relevancy < {pri.image_low_to_irrelevant}{d}")
    rant = b(f"coalesce(p_rant, 0{d}) >= {th.rant}{d}")
    if sw.enable_device_location_prior:
        rant += " OR " + b(f"distance_km > {pri.far_km}{d} AND ({b('never_been_cues')} OR "
                           f"{b(f'experiential_score < {C.EXPERIENTIAL_LOW}{d}')})")
    raises = []
    if sw.enable_username_prior:
        raises.append((b(f"user_name_gibberish >= {pri.username_gibberish_to_spam}{d}"), C.SPAM_RAISE_USERNAME))
    if sw.enable_image_relevance:
        raises.append((b(f"image_relevancy < {pri.image_irrelevant_to_spam}{d}"), C.SPAM_RAISE_IMAGE))
    if sw.enable_dup_burst_prior:
        raises.append((b(f"user_burst_24h >= {pri.burst_24h_to_spam}"), C.SPAM_RAISE_BURST))
        raises.append((b("dup_across_places"), C.SPAM_RAISE_DUP))
    if sw.enable_readability_prior:
        raises.append((b(f"char_entropy < {pri.low_entropy_to_spam}{d}"), C.SPAM_RAISE_ENTROPY))
    if sw.enable_profanity_prior:
        raises.append((f"({b('profanity_count > 0')} AND (experiential_score IS NULL OR "
                       f"{b(f'experiential_score < {C.EXPERIENTIAL_LOW}{d}')} OR "
                       f"{b(f'relevancy < {C.PROFANITY_RELEVANCY_CUT}{d}')}))", C.SPAM_RAISE_PROFANITY))
    spam = ", ".join([f"coalesce(p_spam, 0{d})"] + [f"CASE WHEN {c} THEN {v}{d} ELSE 0{d} END" for c, v in raises])
    return (f"concat_ws('|', CASE WHEN coalesce(p_ad, 0{d}) >= {th.ad}{d} THEN {q(C.AD)} END, "
            f"CASE WHEN {irr} THEN {q(C.IRRELEVANT)} END, "
            f"CASE WHEN {rant} THEN {q(C.RANT)} END, "
            f"CASE WHEN greatest({spam}) >= {th.spam}{d} THEN {q(C.SPAM)} END)")


def terms_list(toks: str) -> str:
    """Unigrams then space-joined bigrams of a token-list column."""
    return f"list_concat({toks}, list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1]))"


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower(coalesce({t}, '')), {q(P.token_pattern())})"


def relevancy_ctes(pairs: str, vocab: int | None = 50000) -> str:
    """CTEs computing ``rel(row_no, review_id, relevancy)`` from a CTE named
    ``pairs`` with columns (row_no, review_id, t, d)."""
    limit = f"LIMIT {vocab}" if vocab else ""
    return f"""
pt AS (SELECT row_no, {tokens('t')} AS toks FROM {pairs}),
a AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest({terms_list('toks')}) AS term FROM pt) GROUP BY row_no, term),
dd AS (SELECT d, count(*) AS mult, {tokens('d')} AS toks FROM {pairs} GROUP BY d),
b AS (SELECT d, term, count(*) AS tf, any_value(mult) AS mult FROM (SELECT d, mult, unnest({terms_list('toks')}) AS term FROM dd) GROUP BY d, term),
stats AS (SELECT term, sum(ttf) AS ttf, sum(dfr) AS dfr FROM (SELECT term, tf AS ttf, 1 AS dfr FROM a UNION ALL SELECT term, tf * mult, mult FROM b) GROUP BY term),
vocab AS (SELECT term, ln((1.0 + (SELECT 2 * count(*) FROM {pairs})) / (1.0 + dfr)) + 1.0 AS idf FROM stats ORDER BY ttf DESC, term ASC {limit}),
wa AS (SELECT a.row_no, a.term, a.tf * v.idf AS w FROM a JOIN vocab v ON v.term = a.term),
wb AS (SELECT b.d, b.term, b.tf * v.idf AS w FROM b JOIN vocab v ON v.term = b.term),
na AS (SELECT row_no, sqrt(sum(w * w)) AS na FROM wa GROUP BY row_no),
nb AS (SELECT d, sqrt(sum(w * w)) AS nb FROM wb GROUP BY d),
dots AS (SELECT p.row_no, sum(wa.w * wb.w) AS dot FROM {pairs} p JOIN wa ON wa.row_no = p.row_no
         JOIN wb ON wb.d = p.d AND wb.term = wa.term GROUP BY p.row_no),
rel AS (SELECT p.row_no, p.review_id, CASE WHEN na.na * nb.nb > 0 THEN least(1.0, greatest(0.0, coalesce(dots.dot, 0.0) / (na.na * nb.nb)))
        ELSE 0.0 END AS relevancy FROM {pairs} p LEFT JOIN na ON na.row_no = p.row_no
        LEFT JOIN nb ON nb.d = p.d LEFT JOIN dots ON dots.row_no = p.row_no)"""


def place_desc(name: str, cat: str, city: str, desc: str) -> str:
    return (f"concat(coalesce({name}, ''), ' — ', coalesce({cat}, ''), ', ', coalesce({city}, ''), '. ', "
            f"coalesce({desc}, ''))")
