"""Text functions as columns: cleaning, windows, pages, names. All of them run in the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible and direction-changing code points that are deleted before text is shown.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
INVISIBLE_CLASS = "[\u200b-\u200d\u2060\ufeff\u202a-\u202e\u2066-\u2069]"
# The mark that stands for white space in defused text, the line prefix, the longest unbroken run, what counts as white space there.
MARK, PREFIX, RUN, DEFUSED_SPACE = "\u02c6", "\u276f ", 24, " \t\r\f\x0b\u00a0"
#: Pages have this many characters unless asked otherwise, and at most.
PAGE, PAGE_MOST = 4000, 40000
# White space that is trimmed off names and values, beyond what SQL's trim removes.
UNICODE_SPACE = "[\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Longest file name in bytes, longest extension kept when cutting, longest sheet name.
NAME_BYTES, EXTENSION_BYTES, SHEET_BYTES = 150, 20, 31
# Markup that is dropped with its content, tags that break a line, and any other tag.
DROPPED, BREAKING, TAG = r"(?is)<(script|style|head)\b.*?</(script|style|head)>", r"(?i)<(/?(p|div|tr|li|h[1-6]|blockquote|table)|br[\t\n\f\r ]*/?)>", r"<[^>]*>"
# character references: by number, by a name with its semicolon, or by one of the old names that need none, the longest that fits
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_OFTEN = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "auml;", "ouml;", "uuml;", "szlig;", "euro;", "copy;", "middot;", "ndash;", "mdash;", "eacute;", "agrave;", "apos;")
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};|(?:" + "|".join(_OLD_NAMES) + "))"


def strip_invisible(text: Column) -> Column:
    """Without the invisible code points."""
    return F.translate(text, INVISIBLE, "")


def contains_invisible(text: Column) -> Column:
    """If an invisible code point occurs."""
    return text.rlike(INVISIBLE_CLASS)


def trim_space(text: Column) -> Column:
    """Trimmed of all Unicode white space."""
    return F.regexp_replace(text, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def defuse(text: Column) -> Column:
    """Text that no longer reads as prose: marks for white space and in long runs, a prefix on every line."""
    clean = F.replace(strip_invisible(text), F.lit(MARK), F.lit("^"))
    space = f"[{DEFUSED_SPACE}]"

    def line(x: Column) -> Column:
        broken = F.regexp_replace(x, f"([^{DEFUSED_SPACE}]{{{RUN}}})(?=[^{DEFUSED_SPACE}])", f"$1{MARK}")
        return F.concat(F.lit(PREFIX), F.regexp_replace(broken, f"{space}+", MARK))

    return F.array_join(F.transform(F.split(clean, "\n", -1), line), "\n")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows of ``size`` over ``n`` items; the last window is the first to reach the end; none over none."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * F.lit(step))).otherwise(F.array().cast("array<int>"))


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start, window>> of sliding character windows."""
    return F.transform(window_starts(F.length(text), size, overlap), lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("window")))


def segments(text: Column, target: int = 200, most: int = 400, overlap: int = 80) -> Column:
    """Sentences and lines packed into blocks of at most ``target`` characters; a longer piece than ``most`` is windowed alone.

    Blocks are trimmed and empty ones dropped; windows of long pieces are not trimmed.
    """
    enders = "[.!?\u2026]+[\\s\"')\\]]|\\n+"
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).+?(?:{enders}|\\z)"), F.lit(0))
    state = "struct<blocks:array<string>,open:string>"
    flush = lambda s: F.when(F.length(trim_space(s["open"])) > 0, F.array_append(s["blocks"], trim_space(s["open"]))).otherwise(s["blocks"])

    def step(s: Column, p: Column) -> Column:
        long = F.struct(F.concat(flush(s), F.transform(windows(p, most, overlap), lambda w: w["window"])).alias("blocks"), F.lit("").alias("open"))
        full = F.struct(flush(s).alias("blocks"), p.alias("open"))
        more = F.struct(s["blocks"].alias("blocks"), F.concat(s["open"], p).alias("open"))
        return F.when(F.length(p) > most, long).when((F.length(s["open"]) > 0) & (F.length(s["open"]) + F.length(p) > target), full).otherwise(more).cast(state)

    zero = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit("").alias("open")).cast(state)
    return F.aggregate(pieces, zero, step, flush)


def page(text: Column, offset: Column | int, limit: Column | int = 0) -> Column:
    """struct<page, total_chars, offset, next_offset, has_more> of one page of characters; the offset is echoed as asked for."""
    offset, limit = (x if isinstance(x, Column) else F.lit(x) for x in (offset, limit))
    n = F.length(text)
    size = F.when(limit <= 0, F.lit(PAGE)).otherwise(F.least(limit, F.lit(PAGE_MOST)))
    start = F.least(F.greatest(offset, F.lit(0)), n)
    end = F.least(start + size, n)
    return F.struct(F.substring(text, start + 1, size).alias("page"), n.alias("total_chars"), offset.alias("offset"), end.alias("next_offset"), (end < n).alias("has_more"))


def _numbered(number: Column) -> Column:
    """The character of a number as HTML reads it: what browsers show for C1 controls, U+FFFD for what is no character."""
    c1 = F.create_map(*[F.lit(x) for i in range(0x80, 0xA0) for x in (i, bytes([i]).decode("cp1252", "ignore") or chr(i))])
    none = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF) | number.isNull()
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(none, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
    return F.when(number.between(0x80, 0x9F), c1[number.cast("int")]).otherwise(plain)


def unescape(text: Column) -> Column:
    """Text with HTML's character references decoded once: all names of the standard, and numbers; unknown names stay."""
    table = lambda of: F.create_map(*[F.lit(x) for n in of for x in (n, html5[n])])
    # most references are by a few names; a map is searched from its beginning
    often, names = table(_OFTEN), table(html5)

    def decoded(r: Column) -> Column:
        digits = F.regexp_replace(r, "^#[xX]?0*(?=.)|;$", "")
        # longer ones are beyond all characters
        number = F.when(F.length(digits) <= 9, F.when(F.lower(F.substring(r, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint"))
        # a name that is unknown as a whole may begin with one of the old ones
        head = F.regexp_extract(r, "^(" + "|".join(_OLD_NAMES) + ")", 1)
        named = F.coalesce(often[r], names[r], F.when(head != "", F.concat(names[head], F.substring(r, F.length(head) + 1, F.lit(40)))), F.concat(F.lit("&"), r))
        return F.when(F.startswith(r, F.lit("#")), _numbered(number)).otherwise(named)

    def whole(t: Column) -> Column:
        pieces = F.split(t, "&", -1)
        later = F.slice(pieces, F.lit(2), F.size(pieces))
        found = F.transform(later, lambda p: F.regexp_extract(p, _REFERENCE, 0))
        read = F.zip_with(later, found, lambda p, r: F.when(r == "", F.concat(F.lit("&"), p)).otherwise(F.concat(decoded(r), F.substring(p, F.length(r) + 1, F.length(p)))))
        return F.when(t.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(read, ""))).otherwise(t)

    # as the variable of a function the text is made once, whatever it is made of
    return F.get(F.transform(F.array(text), whole), F.lit(0))


def html_to_text(html: Column) -> Column:
    """Readable text of HTML: scripts, styles and heads dropped, block tags as line breaks, other tags dropped, character references decoded."""
    t = F.regexp_replace(html, DROPPED, "")
    t = F.regexp_replace(t, BREAKING, "\n")
    t = unescape(F.regexp_replace(t, TAG, ""))
    return trim_space(F.regexp_replace(t, "\n{3,}", "\n\n"))


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_replace(path, r"(?s)^.*[/\\]", "")


def cut_bytes(text: Column, most: Column | int) -> Column:
    """The longest prefix of at most ``most`` bytes in UTF-8 that ends with a whole character."""
    most = most if isinstance(most, Column) else F.lit(most)
    raw = F.encode(text, "UTF-8")
    # a cut within a character leaves up to three bytes of it, which are dropped as invalid
    part = F.substring(raw, F.lit(1), most)
    whole = F.regexp_replace(F.make_valid_utf8(part.cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def sanitize_filename(name: Column, fallback: Column | str) -> Column:
    """A name that is safe in a folder: no separators, controls or invisible characters, at most 150 bytes with its extension kept."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    n = F.regexp_replace(basename(strip_invisible(name)), "[\\x00-\\x1f\\x7f]", "")
    n = F.btrim(F.regexp_replace(n, r'[:*?"<>|]', "_"), F.lit(" ."))
    ext = F.regexp_extract(n, r"(?s)^.+(\.[^.]*)$", 1)
    kept = F.when(F.octet_length(ext) <= EXTENSION_BYTES, ext).otherwise(F.lit(""))
    n = F.when(F.octet_length(n) > NAME_BYTES, F.concat(cut_bytes(n, F.lit(NAME_BYTES) - F.octet_length(kept).cast("int")), kept)).otherwise(n)
    return F.when(F.coalesce(n, F.lit("")) == "", fallback).otherwise(n)


def insert_before_extension(name: Column, what: Column) -> Column:
    """``what`` before the last dot that isn't the first character, or at the end."""
    stem, ext = F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)$", 1), F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)$", 2)
    return F.when(stem != "", F.concat(stem, what, ext)).otherwise(F.concat(name, what))


def hash_suffix(name: Column, sha256: Column) -> Column:
    """A short content hash before the extension; unchanged for a hash of fewer than eight characters."""
    return F.when(F.length(sha256) >= 8, insert_before_extension(name, F.concat(F.lit("-"), F.substring(sha256, 1, 8)))).otherwise(name)


def addresses(people: Column) -> Column:
    """``Name <address>`` or the bare address of array<struct<name, address>>, joined by commas."""
    one = lambda p: F.when(F.coalesce(p["name"], F.lit("")) != "", F.concat(p["name"], F.lit(" <"), p["address"], F.lit(">"))).otherwise(p["address"])
    return F.array_join(F.transform(people, one), ", ")


def doc_link(template: str, filename: Column) -> Column:
    """The template with the file name in it, escaped for a query: blanks as plus, tilde kept, asterisk escaped."""
    escaped = F.replace(F.replace(F.url_encode(filename), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(F.lit(template), F.lit("{filename}"), escaped)


def sheet_name(registry: Column) -> Column:
    """At most 31 bytes, the longest name that a sheet may have."""
    return cut_bytes(registry, SHEET_BYTES)
