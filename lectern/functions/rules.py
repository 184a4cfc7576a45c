"""Small rules of documents under review as columns: page samples, issue keys, labels, mappings, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import technical_tokens

# Names of errors, spellings of numbered labels.
SPLIT_ERRORS = ["DeepSeekOutputLimitError", "DeepSeekProtocolError", "TranslationValidationError"]
NUMBERED = r"(?i)\b(fig(?:ure)?|table|algorithm|code)\s*\.?\s*(\d+(?:[.-]\d+)*|[IVXLCDM]+)\b"


def sample_pages(pages: Column) -> Column:
    """First, last, middle, quarter and three-quarter page of a document, each from a length on, the first four of them
    in page order; null for null."""

    def share(x: float) -> Column:
        return F.ceil(pages * F.lit(x)).cast("int")

    picks = F.array(F.lit(1), pages.cast("int"), F.when(pages > 2, share(0.5)), F.when(pages > 4, share(0.25)), F.when(pages > 6, share(0.75)))
    return F.when(pages.isNotNull(), F.slice(F.array_sort(F.array_distinct(F.array_compact(picks))), 1, 4))


def issue_key(page: Column, kind: Column, box: list[Column], evidence: Column) -> Column:
    """Key of an issue: page, kind, its box rounded to tens (halves up) and its evidence in lower case."""
    tens = [(F.floor(x / 10 + 0.5) * 10).cast("long").cast("string") for x in box]
    return F.concat_ws("|", page.cast("string"), kind, *tens, F.lower(F.trim(evidence)))


def label_identity(label: Column) -> Column:
    """``figure:3`` of 'Fig. 3', ``table:iv`` of 'Table IV'; null where no numbered label is found."""
    kind, number = F.lower(F.regexp_extract(label, NUMBERED, 1)), F.lower(F.regexp_extract(label, NUMBERED, 2))
    return F.when(number != "", F.concat(F.when(kind.startswith("fig"), "figure").otherwise(kind), F.lit(":"), number))


def contradictory_link(tail_hint: Column, head_hint: Column, tail_label: Column, head_label: Column) -> Column:
    """Whether a page's last region and the next page's first one can't be one: a hint says so, or numbers differ."""
    hints = F.coalesce(tail_hint.isin("none", "ends"), F.lit(False)) | F.coalesce(head_hint.isin("none", "starts"), F.lit(False))
    return hints | F.coalesce(label_identity(tail_label) != label_identity(head_label), F.lit(False))


def splits_batch(error: Column) -> Column:
    """Whether an error of this name is answered by halving the batch."""
    return F.coalesce(error.isin(SPLIT_ERRORS), F.lit(False))


def exact_mapping(expected: Column, groups: Column) -> Column:
    """Whether ``groups`` (structs of src and dst, arrays of strings) name every expected id once and in order, and no
    group lacks sources or has an empty or blank target."""
    broken = F.exists(groups, lambda g: (F.size(g["src"]) == 0) | (F.size(g["dst"]) == 0) | F.exists(g["dst"], lambda x: F.trim(x) == ""))
    return (F.flatten(F.transform(groups, lambda g: g["src"])) == expected) & ~broken


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\u3000]+", " "))


def valid_spans(left: Column, right: Column, spans: Column) -> Column:
    """Of ``spans`` (structs of left and right) those whose sides are both found in their text, in lower case and with
    single blanks; the first of equal ones, in the order of their left sides (by code points). Empty sides are none."""
    kind = "array<struct<left:string,right:string>>"
    plain = F.transform(F.coalesce(spans, F.array().cast(kind)), lambda s: F.struct(_plain(s["left"]).alias("a"), _plain(s["right"]).alias("b"), s["left"].alias("left"), s["right"].alias("right")))

    def valid(x: Column) -> Column:
        found = F.filter(x["spans"], lambda s: (s["a"] != "") & (s["b"] != "") & F.contains(x["left"], s["a"]) & F.contains(x["right"], s["b"]))
        return F.transform(F.array_sort(_first_of_equal(found)), lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))

    # Bound as one element: texts are brought to their plain form once, not again for each span.
    return F.transform(F.array(F.struct(_plain(left).alias("left"), _plain(right).alias("right"), plain.alias("spans"))), valid)[0]


def _first_of_equal(found: Column) -> Column:
    """Structs (a, i, left, right) of the first of those that have the same sides, with their places."""

    def first(x: Column) -> Column:
        keyed = F.transform(x["found"], lambda s, i: F.struct(s["a"].alias("a"), i.alias("i"), s["left"].alias("left"), s["right"].alias("right")))
        return F.filter(keyed, lambda s: F.array_position(x["key"], F.element_at(x["key"], s["i"] + 1)) == s["i"] + 1)

    def keys(x: Column) -> Column:
        return F.struct(x.alias("found"), F.transform(x, lambda s: F.concat(s["a"], F.lit("|"), s["b"])).alias("key"))

    return F.transform(F.transform(F.array(found), keys), first)[0]


def continue_entry(entry: Column, line: Column) -> Column:
    """A bibliography entry and its next line: a word's hyphen goes, one before digits stays, addresses go on without a
    blank, all else gets one."""
    url = F.regexp_extract(entry, r"(?i)https?://\S+$", 0)
    goes_on = (url.rlike(r"[./:]$") & line.rlike(r"^[A-Za-z0-9/?#]")) | (entry.rlike(r"(?i)https?:$") & line.startswith("//"))
    cut = entry.endswith("-") & line.rlike("^[a-z]")
    return F.when(cut, F.concat(F.left(entry, F.length(entry) - 1), line)).when((entry.endswith("-") & line.rlike(r"^\d")) | goes_on, F.concat(entry, line)).otherwise(F.concat(entry, F.lit(" "), line))


# What a term of a query is searched by besides.
EXPANSIONS = {
    "chiplet": ["die-to-die", "ucie", "2.5d", "3d-integration", "advanced-packaging"],
    "tsv": ["through-silicon-via", "thermal", "3d-integration"],
    "eda": ["placement", "routing", "verification", "synthesis"],
    "cmos": ["mosfet", "vlsi", "integrated-circuit"],
}


def expanded_query(query: Column, extra: Column | None = None, expansions: dict[str, list[str]] = EXPANSIONS) -> Column:
    """The query, its technical tokens, each followed by its expansions, and ``extra`` terms (an array, null for none):
    the distinct ones joined by blanks."""
    others = F.create_map(*[x for k, v in expansions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    own = F.flatten(F.transform(technical_tokens(query), lambda t: F.concat(F.array(t), F.coalesce(F.element_at(others, t), none))))
    return F.array_join(F.array_distinct(F.concat(F.array(F.coalesce(query, F.lit(""))), own, none if extra is None else F.coalesce(extra, none))), " ")


# Numbers of headings. Decimal ones, Roman ones (alone only I, V and X), letters with a dot.
HEADING = r"(^|\s)(?:(\d{1,2}(?:\.\d{1,2}){0,2})\.?|([IVXLCDM]{2,8}|[IVX])\.?|([A-Z])\.)\s+(?=[A-Za-zÀ-ɏ㐀-鿿])"
HEADING_NUMBER = r"^\s*(\d+(?:\.\d+)*)\b"
BEGIN, FIELD, BODY = "\ue000", "\ue001", "\ue002"  # private characters mark the parts; those of a source go


def heading_parts(source: Column) -> Column:
    """The headings of a block, array of (number, level, text): '2 Background 2.1 Motivation' holds two. A block that does
    not begin with a number is one heading of level 1 without a number; a null or blank one has none. Decimal numbers have
    a level by their dots, 3 at most, letters 2, Roman numbers 1; a number without a text is left out."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), f"[\r{BEGIN}{FIELD}{BODY}]", ""), "[ \t]+", " "))
    plain = F.regexp_replace(plain, r"^\s+|\s+$", "")
    parts = F.split(F.regexp_replace(plain, HEADING, f"{BEGIN}$2{FIELD}$3{FIELD}$4{BODY}"), BEGIN)

    def part(x: Column) -> Column:
        numbers, text = F.split(F.split(x, BODY)[0], FIELD), F.regexp_replace(F.split(x, BODY)[1], r"^\s+|\s+$", "")
        level = F.when(numbers[2] != "", 2).when(numbers[0] != "", F.least(F.lit(3), F.size(F.split(numbers[0], r"\.")))).otherwise(1)
        return F.struct(F.array_join(numbers, "").alias("number"), level.alias("level"), text.alias("text"))

    single = F.array(F.struct(F.lit(None).cast("string").alias("number"), F.lit(1).alias("level"), plain.alias("text")))
    numbered = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), part), lambda x: x["text"] != "")
    return F.when(plain == "", F.slice(single, 1, 0)).when((F.size(parts) > 1) & (parts[0] == ""), numbered).otherwise(single)


def restored_heading(source: Column, target: Column) -> Column:
    """A translated heading with the source's decimal number in front, where the number stands elsewhere in it (the first
    place goes); as it is where it leads already, is missing, or the source has none."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), HEADING_NUMBER, 1)
    quoted = F.replace(number, F.lit("."), F.lit("[.]"))
    bare = F.regexp_replace(target, r"^\s+|\s+$", "")
    leads = F.rlike(bare, F.concat(F.lit("^"), quoted, F.lit(r"(?:\s|[：:、.．])")))
    place = F.concat(F.lit(r"(?s)^(.*?)(?<![\d.])"), quoted, F.lit(r"(?![\d.])"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, place, F.lit("$1")), r"\s{2,}", " "), r"^\s+|\s+$", "")
    return F.when((number == "") | leads | ~F.rlike(bare, place), target).otherwise(F.trim(F.concat(number, F.lit(" "), rest)))
