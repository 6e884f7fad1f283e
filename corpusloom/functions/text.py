"""Text functions as column expressions: cleaning, extraction, hashing, truncation, templates.

Empty text counts as missing wherever a value is "present" or not; null text is treated as empty text unless said otherwise.
White space is Unicode white space (ideographic and no-break spaces included) in the cleaners.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(c: Column, places: int) -> Column:
    """A double rounded by its exact binary value, halves to even: 2.675 is below its half and gives 2.67, 0.125 gives 0.12.

    Spark's round goes by the shortest decimal that names the double, and halves up. NaN and infinities stay, null is null.
    """
    if places < 0:
        raise ValueError("places must not be negative")
    pattern = "0." + "0" * places if places else "0"
    usual = F.abs(c) < F.lit(float("inf"))
    return F.when(usual, F.call_function("format_number", c.cast("double"), F.lit(pattern)).cast("double")).otherwise(c.cast("double"))


def text_of(c: Column) -> Column:
    """Null as empty text."""
    return F.coalesce(c, F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def runs(items: Column, begins: Callable[[Column], Column] | None = None, by: Callable[[Column], Column] | None = None) -> Column:
    """An array cut into arrays: before each element for which ``begins`` is true, or for which ``by`` isn't as for the one before."""
    cut = lambda xs, x, i: begins(x) if begins else by(x) != by(F.get(xs, i - 1))
    firsts = lambda xs: F.array_compact(F.transform(xs, lambda x, i: F.when((i == 0) | cut(xs, x, i), i)))
    upto = lambda at, k, xs: F.coalesce(F.get(at, k + 1), F.size(xs))
    return let(items, lambda xs: let(firsts(xs), lambda at: F.transform(at, lambda a, k: F.slice(xs, a + 1, upto(at, k, xs) - a))))


def not_blank(c: Column) -> Column:
    """Whether a text has anything but white space; null has nothing. Cheaper than to clean a line and look what is left."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def present(c: Column) -> Column:
    """The value, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(present(c) for c in columns))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text_of(c), r"(?U)^\s+|\s+$", "")


def clean_line(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text_of(c), r"(?U)\s+", " "), "^ | $", "")


#: Unicode white space, by code point.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def compact(c: Column) -> Column:
    """Without any white space."""
    return F.translate(text_of(c), WHITE, "")


def clean_text(c: Column) -> Column:
    """Block cleaning: ideographic spaces and runs of blanks as one space, at most one blank line in a row."""
    blanks = F.regexp_replace(F.replace(text_of(c), F.lit("　"), F.lit(" ")), "[ \\t\\r\\f\\x0B]+", " ")
    return strip(F.regexp_replace(blanks, "\\n\\s*\\n\\s*\\n+", "\n\n"))


def lines(c: Column) -> Column:
    """Non-empty lines of a text, each cleaned."""
    return F.filter(F.transform(F.split(text_of(c), "\n"), clean_line), lambda x: x != "")


def drop_lines(c: Column, exact=(), prefixes=(), containing=(), patterns=(), stop_at=()) -> Column:
    """A text without noise lines.

    A line goes if it equals one of ``exact``, begins with one of ``prefixes``, contains one of ``containing`` or matches one of
    ``patterns`` wholly; the first line with one of ``stop_at`` ends the text.
    """
    kept = lines(c)
    if stop_at:
        marks = F.transform(kept, lambda x: _any(F.contains, x, stop_at))
        end = F.array_position(marks, True)
        kept = F.when(end > 0, F.slice(kept, F.lit(1), F.greatest(F.lit(0), (end - 1).cast("int")))).otherwise(kept)

    def noise(x: Column) -> Column:
        tests = [x.isin(*exact)] if exact else []
        tests += [_any(F.startswith, x, prefixes)] if prefixes else []
        tests += [_any(F.contains, x, containing)] if containing else []
        tests += [x.rlike(f"^(?:{p})$") for p in patterns]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    return F.array_join(F.filter(kept, lambda x: ~noise(x)), "\n")


def _any(test, c: Column, values) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(c, F.lit(v))
    return out


def take_while(items: Column, keep) -> Column:
    """The elements of an array before the first for which ``keep`` is false."""
    end = F.array_position(F.transform(items, lambda x: F.coalesce(keep(x), F.lit(False))), False)
    return F.when(end > 0, F.slice(items, F.lit(1), F.greatest(F.lit(0), (end - 1).cast("int")))).otherwise(items)


def statute_lines(c: Column) -> Column:
    """The statute field of a case up to a heading, a trial level, or a line that cites nothing."""
    stays = lambda x: ~x.rlike("^#|^[一二三四五六七八九十]+审[:：]") & (F.contains(x, F.lit("《")) | F.contains(x, F.lit("条")))
    return F.array_join(take_while(lines(c), stays), "\n")


def legitimate_share(c: Column, allowed: str) -> Column:
    """Share of a text's characters in the character class ``allowed``; 0 for empty text."""
    n = F.length(text_of(c))
    return F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(text_of(c), f"[^{allowed}]", "")) / n)


def drop_garbage(c: Column, allowed: str = r"\p{L}\p{N}\p{P}\s", least: float = 0.6) -> Column:
    """A text without lines of which fewer than ``least`` characters are allowed, or that have only symbols."""
    good = lambda x: (legitimate_share(x, allowed) >= least) & x.rlike(r"[\p{L}\p{N}]")
    return F.array_join(F.filter(lines(c), good), "\n")


def truncate_bytes(c: Column, most: int, mark: str = "") -> Column:
    """At most ``most`` UTF-8 bytes of a text, cut between characters; ``mark`` follows only if something was cut."""
    raw = text_of(c).cast("binary")
    cut = F.make_valid_utf8(F.substring(raw, 1, most))
    # only where the cut is inside a character is a last � its rest; the text may have others of its own
    inside = F.hex(F.substring(raw, most + 1, 1)).between("80", "BF")
    cut = F.when(inside, F.regexp_replace(cut, r"�\z", "")).otherwise(cut)
    return F.when(F.octet_length(text_of(c)) <= most, text_of(c)).otherwise(F.concat(cut, F.lit(mark)))


def first_match(c: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches, empty if none does."""
    return F.coalesce(*(present(F.regexp_extract(text_of(c), p, 1)) for p in patterns), F.lit(""))


def label_value(c: Column, label: str) -> Column:
    """The value of ``label: value``, on its line or else the next line that isn't blank."""
    return strip(F.regexp_extract(text_of(c), rf"(?m)^\s*{label}\s*[:：]\s*(\S[^\n]*|\n\s*\S[^\n]*)", 1))


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """prefix_ with the front of the sha256 of the cleaned parts, one a line; null parts are left out."""
    cleaned = [F.when(p.isNotNull(), clean_line(p.cast("string"))) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(F.concat_ws("\n", *cleaned), 256), F.lit(length)))


def normalize_title(c: Column) -> Column:
    """A title as a key: no white space, brackets, marks, years or trial notes, in small letters."""
    bare = F.regexp_replace(compact(c), "[《》“”\"'（）()【】\\[\\]：:，,。；;、|｜_-]", "")
    return F.lower(F.regexp_replace(bare, r"\d{4}年|\d{4}版|（试行）|试行|修订版", ""))


def best_title(candidates: list[Column], notices=("已于", "现予公布"), default: str = "未命名") -> Column:
    """Of the present candidates, one without notice words before one with, the shortest, the first."""
    options = []
    for pos, c in enumerate(candidates):
        v = clean_line(c)
        options.append(F.when(v != "", F.struct(_any(F.contains, v, notices).alias("notice"), F.length(v).alias("size"), F.lit(pos).alias("pos"), v.alias("value"))))
    return F.coalesce(F.array_min(F.array_compact(F.array(*options)))["value"], F.lit(default))


def recover_title(title: Column, body: Column, formal: str, suffixes: tuple[str, ...], head: int = 1500) -> Column:
    """The title, or if it has no formal suffix, the longest formal title in the body's head that is longer than it."""
    t = clean_line(title)
    found = F.transform(F.regexp_extract_all(F.left(text_of(body), F.lit(head)), F.lit(formal), F.lit(0)), clean_line)
    longest = F.array_max(F.transform(found, lambda x, i: F.struct(F.length(x).alias("size"), (-i).alias("pos"), x.alias("value"))))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.endswith(t, F.lit(s))
    return F.when(~ends & (longest["size"] > F.length(t)), longest["value"]).otherwise(t)


def citations(c: Column) -> Column:
    """Array of (law, article) in order of first mention: each article of a 《law》, or the law with a null article."""
    mention = r"《([^《》]+)》((?:\s*(?:第[零〇一二两三四五六七八九十百千万\d]+条(?:之[一二三四五六七八九十]+)?(?:第[零〇一二两三四五六七八九十\d]+款)?(?:第?[（(]?[一二三四五六七八九十\d]+[)）]?项)?|[、,，和及至与]))*)"
    article = r"第[零〇一二两三四五六七八九十百千万\d]+条(?:之[一二三四五六七八九十]+)?(?:第[零〇一二两三四五六七八九十\d]+款)?(?:第?[（(]?[一二三四五六七八九十\d]+[)）]?项)?"
    laws = F.regexp_extract_all(text_of(c), F.lit(mention), F.lit(1))
    tails = F.regexp_extract_all(text_of(c), F.lit(mention), F.lit(2))

    def rows(pair: Column) -> Column:
        law = law_name(pair["law"])
        cited = F.regexp_extract_all(pair["tail"], F.lit(article), F.lit(0))
        one = F.array(F.struct(law.alias("law"), F.lit(None).cast("string").alias("article")))
        return F.when(F.size(cited) > 0, F.transform(cited, lambda a: F.struct(law.alias("law"), a.alias("article")))).otherwise(one)

    pairs = F.transform(F.arrays_zip(laws.alias("law"), tails.alias("tail")), lambda p: F.struct(p["law"].alias("law"), p["tail"].alias("tail")))
    return F.array_distinct(F.filter(F.flatten(F.transform(pairs, rows)), lambda x: x["law"] != ""))


def law_name(c: Column) -> Column:
    """A law's name without title marks, white space and the country's name."""
    return F.regexp_replace(compact(c), "《|》|中华人民共和国", "")


def sentences(c: Column) -> Column:
    """Sentences with the mark that ends each."""
    return F.filter(F.split(text_of(c), "(?<=[。！？；])"), lambda x: x != "")


def inline_articles(c: Column) -> Column:
    """A line with several articles as pieces; what stands before the first stays with it."""
    parts = F.filter(F.split(text_of(c), "(?=第[零〇一二两三四五六七八九十百千万\\d]+条)"), lambda x: F.trim(x) != "")
    head = F.get(parts, F.lit(0))
    merged = F.concat(F.array(F.concat(head, F.get(parts, F.lit(1)))), F.slice(parts, F.lit(3), F.greatest(F.lit(0), F.size(parts) - 2)))
    return F.when((F.size(parts) > 1) & ~head.rlike("^\\s*第[零〇一二两三四五六七八九十百千万\\d]+条"), merged).otherwise(parts)


def excerpt(c: Column, limit: int, signals: tuple[str, ...], least: int = 120) -> Column:
    """A text within ``limit`` as it is; else its lines with a signal term, if they make least..limit; else its front."""
    t = clean_text(c)
    useful = F.array_join(F.filter(lines(c), lambda x: _any(F.contains, x, signals)), "\n")
    cut = F.regexp_replace(F.left(t, F.lit(limit)), r"(?U)\s+$", "")
    return F.when(F.length(t) <= limit, t).when(F.length(useful).between(least, limit), useful).otherwise(cut)


def labelled_join(label: str, values: Column, mark: str = "、") -> Column:
    """``label：a、b``, or null if there is no value."""
    some = F.filter(values, lambda x: text_of(x) != "")
    return F.when(F.size(some) > 0, F.concat(F.lit(label + "："), F.array_join(some, mark)))


def template(*parts: Column) -> Column:
    """The present parts, one a line."""
    return F.concat_ws("\n", *(present(p) for p in parts))


def json_list(c: Column, raw_on_error: bool = False) -> Column:
    """A JSON list of texts; anything else is an empty list, or a list of the raw text."""
    other = F.when(text_of(c) == "", F.array().cast("array<string>")).otherwise(F.array(c)) if raw_on_error else F.array().cast("array<string>")
    return F.when(F.ltrim(text_of(c)).startswith("["), F.coalesce(F.from_json(c, "array<string>"), other)).otherwise(other)


def body_of(c: Column) -> Column:
    """What follows the first blank line, or the whole text."""
    return F.coalesce(F.get(F.split(c, "\n\n", 2), F.lit(1)), c)


def file_parts(name: Column) -> tuple[Column, Column, Column]:
    """Name, version and ISO date of ``{name}_{YYYYMMDD}``; the stem, "" and "" for other names."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    pattern = r"^(.+)_(\d{4})(\d{2})(\d{2})$"
    fits = stem.rlike(pattern)
    group = lambda g: F.regexp_extract(stem, pattern, g)
    return F.when(fits, group(1)).otherwise(stem), F.concat(group(2), group(3), group(4)), F.when(fits, F.concat_ws("-", group(2), group(3), group(4))).otherwise("")


def file_kind(content: Column) -> Column:
    """docx, doc, pdf or other by a file's first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("504B"), "docx").when(head == "D0CF11E0", "doc").when(head == "25504446", "pdf").otherwise("other")


def parser_for(name: Column) -> Column:
    """Which parser a file goes to by its extension; unsupported files are an error."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(kind.isin("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"), "ocr").when(kind.isin("pdf", "docx"), "document").otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), name)))


def box_union(boxes: Column) -> Column:
    """[x1, y1, x2, y2] around the valid boxes of an array, null if there is none."""
    valid = F.filter(boxes, lambda b: F.size(b) == 4)
    edge = lambda k, f: f(F.transform(valid, lambda b: F.get(b, F.lit(k))))
    return F.when(F.size(valid) > 0, F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)))


def utc_iso(ts: Column, zone: str) -> Column:
    """ISO text in UTC of a local timestamp."""
    return F.date_format(F.to_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bounded_json(value: Column, most: int) -> Column:
    """JSON of a struct, or if it is longer than ``most``, its size and front."""
    whole = F.to_json(value)
    short = F.to_json(F.struct(F.lit(True).alias("truncated"), F.length(whole).alias("original_chars"), F.left(whole, F.lit(most)).alias("preview")))
    return F.when(F.length(whole) > most, short).otherwise(whole)


def table_markdown(rows: Column, most_columns: int = 6, least_full: float = 0.5) -> Column:
    """An array of rows of cells as Markdown, without empty rows and columns; wide and sparse tables as lines of text."""
    tidy = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(text_of(c)))), lambda r: F.exists(r, lambda c: c != ""))

    def shaped(t: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(t, lambda r: F.size(r))), F.lit(0))
        used = F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda k: F.exists(t, lambda r: F.coalesce(F.get(r, k), F.lit("")) != ""))
        return F.struct(t.alias("rows"), used.alias("used"))

    def said(s: Column) -> Column:
        full = F.aggregate(s["rows"], F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda c: c != "")))
        lines = F.transform(s["rows"], lambda r: F.concat(F.lit("| "), F.array_join(F.transform(s["used"], lambda k: F.replace(F.coalesce(F.get(r, k), F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(s["used"], lambda k: F.lit(" --- |")), ""))
        plain = F.array_join(F.transform(s["rows"], lambda r: F.array_join(F.filter(r, lambda c: c != ""), " ")), "\n")
        sparse = (F.size(s["used"]) > most_columns) & (full < least_full * F.size(s["rows"]) * F.size(s["used"]))
        whole = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
        return F.when(F.size(s["rows"]) == 0, "").when(sparse, plain).otherwise(whole)

    return let(let(tidy, shaped), said)
