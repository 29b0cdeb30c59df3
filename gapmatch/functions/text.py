"""Text kernel: Column expressions over whole corpora (no Python per row, no shuffle).

Every function takes and returns Columns, so it runs inside whatever scan or join feeds it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K


_INNER = rf"[{K.LETTERS}0-9+#.\-]"
#: ``K.WORD`` without a way back: what a part takes is never given up, as no slash is inside a part.
WORD = rf"[{K.LETTERS}](?:{_INNER}++(?:/{_INNER}++)*+|(?:/{_INNER}++)++)"


def no_strings() -> Column:
    """An empty array<string>."""
    return F.expr("cast(array() as array<string>)")


def let(value: Column, body) -> Column:
    """Bind a value to a name for ``body``, so that it is evaluated once.

    The optimizer inlines a projected column into a lambda that reads it, and would then compute it
    again for every element.
    """
    return F.transform(F.array(value), body)[0]


def uni(pattern: str) -> str:
    """Give ``\\b \\w \\d`` and case-insensitivity their Unicode meaning on the JVM."""
    return "(?U)" + K.wide(pattern)


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    """Strip every kind of blank from both ends, without a pattern that is tried at every character between them."""
    return F.btrim(text, F.lit(K.BLANKS))


def strip_chars(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def squeeze(text: Column) -> Column:
    """One space between words, none at the ends."""
    return strip(F.regexp_replace(text, K.wide(r"\s+"), " "))


def words(text: Column) -> Column:
    """Blank-separated words; an empty array for blank text."""
    return F.filter(F.split(text, K.wide(r"\s+")), lambda w: w != "")


def normalise(text: Column) -> Column:
    return F.lower(squeeze(text))


def fold(text: Column) -> Column:
    """Case and diacritics folded away, final sigma normalised (on the token alphabet)."""
    low = F.lower(text)
    # Only characters beyond ASCII are translated.
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, K.FOLD_FROM, K.FOLD_TO))


def tokens(text: Column) -> Column:
    # Lower case keeps the token boundaries of ASCII, so such a text is folded once and then cut.
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, find_all(F.lower(text), WORD)).otherwise(F.transform(find_all(text, WORD), fold))


def is_stopword(token: Column) -> Column:
    return token.isin(*K.STOPWORDS)


def keywords_of(toks: Column, limit: int = K.KEYWORD_LIMIT) -> Column:
    kept = F.filter(toks, lambda t: (F.length(t) >= 2) & ~is_stopword(t))
    return F.slice(F.array_distinct(kept), 1, limit)


def keywords(text: Column, limit: int = K.KEYWORD_LIMIT) -> Column:
    """Content words in order of first use."""
    return keywords_of(tokens(text), limit)


def language(text: Column) -> Column:
    greek = F.regexp_count(text, F.lit(f"[{K.GREEK}]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(
        (greek + latin > 0) & (greek / F.greatest(greek + latin, F.lit(1)) >= K.GREEK_SHARE), "Greek"
    ).otherwise("English")


def has_only_capitals(text: Column) -> Column:
    """At least one letter, and no letter that is not upper case."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")


def lines(text: Column) -> Column:
    return F.split(text, K.LINE_BREAK)


def _breaks_paragraph(line: Column) -> Column:
    heading = (F.length(line) <= 70) & (
        line.endswith(":") | (has_only_capitals(line) & (F.size(words(line)) <= 6))
    )
    return (line == "") | heading


def reflowed(text: Column) -> Column:
    """Hard-wrapped text as array<string> of whole lines, lists and headings kept apart.

    Whether a line continues the one before it depends on those two lines only, so each line gets
    its own joint (blank or line break) and the pieces are glued once: linear in the text, no fold.
    """
    trimmed = F.transform(lines(text), strip)
    marked = F.transform(
        trimmed,
        lambda l: F.struct(
            l.alias("line"),
            _breaks_paragraph(l).alias("apart"),
            F.substring(l, -1, 1).isin(*K.LINE_CLOSERS).alias("closed"),
            l.rlike(r"^[\p{Ll}\x{aa}\x{ba}]").alias("low"),
            l.rlike(uni(K.DANGLING)).alias("dangling"),
        ),
    )

    def glue(rows: Column) -> Column:
        def piece(row, i):
            prev = F.get(rows, i - 1)
            joins = (
                (i > 0) & ~row["apart"] & ~prev["apart"] & ~prev["closed"]
                & (row["low"] | prev["dangling"])
            )
            return F.concat(F.when(joins, " ").otherwise("\n"), row["line"])

        return F.array_join(F.transform(rows, piece), "")

    return F.filter(F.split(let(marked, glue), "\n"), lambda l: l != "")


def reflow(text: Column) -> Column:
    return F.array_join(reflowed(text), "\n")


def salient_terms(text: Column) -> Column:
    """Tokens of words that carry a capital and are not boilerplate, in order of first use."""
    cleaned = F.transform(
        words(text), lambda w: F.regexp_replace(strip_chars(w, K.WORD_TRIM), r"\.+$", "")
    )
    named = F.filter(cleaned, lambda w: (F.length(w) >= 2) & w.rlike(r"\p{Lu}"))
    toks = F.flatten(F.transform(named, tokens))
    kept = F.filter(
        toks,
        lambda t: (F.length(t) >= 2)
        & ~is_stopword(t)
        & ~F.exists(F.split(t, "-"), lambda part: is_stopword(part)),
    )
    return F.array_distinct(kept)


def sentences_of(reflowed_lines: Column) -> Column:
    pieces = F.flatten(
        F.transform(reflowed_lines, lambda l: F.split(l, K.wide(r"(?<=[.!?;])\s+")))
    )
    trimmed = F.transform(pieces, lambda s: strip_chars(s, K.SENTENCE_TRIM))
    return F.filter(
        trimmed,
        lambda s: (F.length(s) >= K.SENTENCE_MIN_CHARS)
        | ((F.length(s) > 0) & (F.size(salient_terms(s)) > 0)),
    )


def sentences(text: Column) -> Column:
    """Citable units, verbatim: long enough, or naming something."""
    return sentences_of(reflowed(text))


def candidate_sentences(text: Column) -> Column:
    """Sentences, or the whole passage on one line when it has none."""
    return let(
        sentences(text),
        lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(squeeze(text))),
    )


def coordinate_groups(text: Column) -> Column:
    """The separate things a requirement names."""
    pattern = uni(
        r"(?i)[,;()\[\]]|\s+/\s+|\b(?:" + "|".join(K.COORDINATORS) + r")\b"
    )
    return F.filter(F.transform(F.split(text, pattern), strip), lambda g: g != "")


def greek_stem(token: Column) -> Column:
    ending = "|".join(K.GREEK_ENDINGS)
    pattern = rf"^(.{{{K.GREEK_STEM_MIN},}}?)(?:{ending})$"
    return F.when(
        token.rlike(f"[{K.GREEK}]"), F.regexp_replace(token, pattern, "$1")
    ).otherwise(token)


def clip(text: Column, n: int) -> Column:
    flat = squeeze(text)
    short = F.regexp_replace(F.left(flat, F.lit(n - 1)), K.wide(r"\s+$"), "")
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(short, F.lit("…")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\0"))]), 256)


def quantity_mentions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(uni(K.QUANTITY)))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal phrase."""
    removed = F.replace(text, F.lit(phrase), F.lit(""))
    return ((F.length(text) - F.length(removed)) / len(phrase)).cast("int")


def phrases_present(lowered: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur at least once."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + F.contains(lowered, F.lit(phrase)).cast("int")
    return total


def first_group(lowered: Column, groups, default: str) -> Column:
    """Name of the first cue list with a cue in the text."""
    chain = None
    for name, cues in groups:
        hit = F.lit(False)
        for cue in cues:
            hit = hit | F.contains(lowered, F.lit(cue))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(default)


def intent(message: Column) -> Column:
    return first_group(F.lower(message), K.INTENTS, "get_match_report")


def requirement_kind(text: Column) -> Column:
    """Naming something is evidenceable whatever surrounds it; a bare trait is not."""
    return (
        F.when(F.size(salient_terms(text)) > 0, "evidenceable")
        .when(text.rlike(uni(K.TRAIT)), "behavioural")
        .otherwise("evidenceable")
    )


def gap_key(requirement: Column) -> Column:
    """First salient term, else first plain token, else empty."""
    return F.coalesce(
        F.try_element_at(salient_terms(requirement), F.lit(1)),
        F.try_element_at(F.filter(tokens(requirement), lambda t: ~is_stopword(t)), F.lit(1)),
        F.lit(""),
    )


def unspace(text: Column) -> Column:
    """Close up letter-spaced runs of four letters or more."""
    closed = F.transform(find_all(text, K.LETTER_SPACED), lambda run: F.replace(run, F.lit(" "), F.lit("")))
    around = F.split(text, K.LETTER_SPACED, -1)  # one more than the runs
    return F.array_join(F.zip_with(around, closed, lambda a, run: F.concat(a, F.coalesce(run, F.lit("")))), "")


def company_from(title: Column, role: Column) -> Column:
    """Employer named in front of the dash, unless that only repeats the role."""
    head = strip(F.split(strip(title), K.TITLE_DASH, 2)[0])
    restates = (role != "") & (F.size(F.array_except(tokens(head), tokens(role))) == 0)
    return F.when(head == "", strip(title)).when(restates, "").otherwise(head)


def restates_role(requirement: Column, role: Column) -> Column:
    a, b = tokens(requirement), tokens(role)
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(a, b)) <= 1)


def is_achievement(quote: Column) -> Column:
    text = strip(F.coalesce(quote, F.lit("")))
    return (
        text.rlike(uni(K.ACHIEVEMENT)) & ~text.rlike(uni(K.DATE_RANGE)) & (F.size(words(text)) >= 6)
    )


def band(score: Column, bands) -> Column:
    """Name of the first band whose floor the score reaches."""
    chain = None
    for floor, name in bands:
        if floor is None:
            return chain.otherwise(name)
        chain = F.when(score >= floor, name) if chain is None else chain.when(score >= floor, name)
    return chain
