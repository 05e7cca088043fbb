"""Text-cleaning, slug, title and filter expressions. All are plain column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------

#: Letters that mark Turkish text.
DIACRITICS = "çğıöşüÇĞİÖŞÜ"

#: Look-alike letters and the Latin letters they stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "х": "x", "у": "y",
    "к": "k", "і": "i", "ѕ": "s", "һ": "h", "ԁ": "d", "в": "b", "т": "t",
    "м": "m", "н": "n", "ј": "j", "ԛ": "q", "ѡ": "w", "ё": "e", "г": "r",
    "А": "A", "Е": "E", "О": "O", "С": "C", "Р": "P", "Х": "X", "У": "Y",
    "К": "K", "М": "M", "Т": "T", "Н": "H", "В": "B", "І": "I", "Ѕ": "S",
    "Ј": "J", "ə": "e", "Ə": "E",
}

#: Language codes of translated paths, first policy.
CODES_V1 = (
    "ar", "bn", "cs", "de", "el", "es", "fa", "fi", "fr", "he", "hi", "hu", "id", "it", "ja", "ko", "ml", "nl", "no", "pl", "pt",
    "pt-br", "ptbr", "ro", "ru", "sk", "sr", "sv", "th", "tr", "uk", "vi", "zh", "zh-cn", "zh-tw", "zh-hans", "zh-hant", "ca",
    "da", "hr", "bg", "az", "fa-ir",
)
#: Two-letter path segments that are no language, first policy.
NOT_LANGUAGES = (
    "en", "js", "io", "ui", "os", "db", "go", "py", "md", "rs", "sh", "cs", "vm", "ci", "ts", "cd", "qa",
)
#: Language codes, second policy.
CODES_V2 = (
    "es", "fr", "de", "el", "el-gr", "gr", "fa", "ar", "ru", "pt", "pt-pt", "pt-br", "zh", "zh-cn", "zh-tw", "ja", "ko", "id",
    "hi", "ml", "tr", "it", "pl", "uk", "vi", "he", "nl", "cs", "ro", "bg", "sr", "hr", "sk", "sl", "da", "sv", "no", "nb", "fi",
    "hu", "th", "bn", "ur", "ca", "az", "kk", "uz", "sw", "fil", "ta", "te", "mr", "gu", "pa", "fa-ir", "zh-hans", "zh-hant",
)
#: Language codes and names that are whole segments, third policy.
CODES_V3 = (
    "es", "fr", "de", "el", "el-gr", "gr", "fa", "ar", "ru", "pt", "pt-pt", "pt-br", "zh", "zh-cn", "zh-tw", "ja", "ko", "id",
    "hi", "ml", "it", "pl", "uk", "vi", "he", "nl", "cs", "ro", "bg", "sr", "hr", "sk", "sl", "da", "sv", "no", "nb", "fi", "hu",
    "th", "bn", "ur", "ca", "az", "kk", "uz", "sw", "fil", "japanese", "french", "basque", "russian", "polish", "portuguese",
    "brazilian-portuguese", "german", "spanish", "chinese", "korean", "italian", "dutch", "arabic", "hebrew", "vietnamese",
    "ukrainian", "czech", "greek", "persian", "indonesian", "hindi", "thai", "romanian", "hungarian", "simplified-chinese",
    "traditional-chinese", "turkish-tr",
)
#: Language names looked for anywhere in a path, third policy.
NAMES_V3 = (
    "japanese", "french", "basque", "russian", "polish", "portuguese", "german", "spanish", "chinese", "korean", "italian",
    "dutch", "arabic", "hebrew", "vietnamese", "ukrainian", "czech", "greek", "persian", "indonesian", "hindi", "thai",
    "romanian", "hungarian", "brazilian", "simplified", "traditional", "indonesia", "espanol", "deutsch", "francais", "italiano",
    "nederlands",
)
#: Path fragments that are skipped: in preparation, and in corpus building.
DENY_PREPARE = ("node_modules/", "/dist/", "vendor/", ".min.", "/migrations/")
DENY_CORPUS = ("node_modules/", "/dist/", "vendor/", ".min.", "/test/fixtures/")
#: Fragments of documents about documents.
DENY_META = (
    "readme", "summary", "_sidebar", "changelog", "/.git", "/translated", "about", "introduction", "contributing",
    "release-note", "next-dev", "foreword", "preface", "glossary", "license", "acknowledg", "roadmap", "credits",
    "sponsor", "code-of-conduct", "citation", "/index.md", "gsoc", "gsod", "/initiatives/", "/social/",
    "all-day-info", "frontispiece", "overview", "taxonomy", "0x02a", "0x03-overview", "/indexes/", "-index",
    "/index-", "matrix", "/_data/", "code_of_conduct", "/.github/", "/aitech-", "workflow-optimization",
)
#: Fixed value: commands that change or fetch things. `Clear-` counts only where a word goes on, as it ends on a boundary.
RISKY_COMMANDS = r"(?i)\b(rm|rmdir|del|erase|format|mkfs|dd|shutdown|restart|reg\s+delete|rd|Remove-Item|Clear-|Stop-Computer|Restart-Computer|Format-Volume|diskpart|Invoke-Expression|iex|Invoke-WebRequest|iwr|Invoke-RestMethod|irm|curl|wget|Set-Content|Add-Content|Out-File|Start-Process|New-Service|Set-ItemProperty|Set-ExecutionPolicy)\b|>\s*/dev/|:\s*>\s*"
PROMPT_HEADERS = ("### Talimat:\n", "\n\n### Girdi:\n", "\n\n### Yanit:\n")

_TURKISH = ("çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")


# --- cleaning -----------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """White space off both ends; trim() takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_markdown(c: Column, variant: str = "prepare") -> Column:
    """Markup off, link texts kept. "prepare" drops comments and keeps code; "retrieve" replaces fenced code and drops all tags."""
    if variant == "prepare":
        c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    else:
        c = F.regexp_replace(c, r"(?s)```.*?```", " [kod] ")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return c if variant == "prepare" else F.regexp_replace(c, r"<[^>]+>", "")


def clean_rst(c: Column, variant: str = "prepare") -> Column:
    """Roles to their text, directives off."""
    if variant == "prepare":
        c = F.regexp_replace(c, r":[a-z]+:`([^`]+)`", "$1")
        lines = F.filter(F.split(c, r"\r\n|\r|\n"), lambda s: ~F.regexp_replace(s, r"^\s+", "").startswith(".. "))
        return F.array_join(lines, "\n")
    c = F.regexp_replace(c, r"::\n", ":\n")
    c = F.regexp_replace(c, r":[a-z:]+:`~?([^`<]+?)(?:\s*<[^>]*>)?`", "$1")
    c = F.regexp_replace(c, r"\.\. [a-z-]+::.*", "")
    return F.regexp_replace(c, r"(?m)^\s*\.\..*$", "")


def clean_by_kind(c: Column, kind: Column) -> Column:
    """A text for retrieval as its extension wants it: reStructuredText roles and directives off for "rst" and "txt", else Markdown's markup."""
    return F.when(kind.isin("rst", "txt"), clean_rst(c, "retrieve")).otherwise(clean_markdown(c, "retrieve"))


def clean_html(c: Column) -> Column:
    """Scripts, styles and tags to spaces, long gaps to one empty line. Entities stay."""
    c = F.regexp_replace(c, r"(?is)<script.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style.*?</style>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


#: Fixed value: where a text's lines end.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(c: Column) -> Column:
    """The lines of a text; an end of line behind the last begins none."""
    lines = F.split(c, LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def decode_leniently(content: Column) -> Column:
    """Binary content as text, bytes that are no UTF-8 left out; a replacement character that stands there stays."""
    raw = content.cast("string")
    kept = F.replace(F.replace(raw, F.lit("\ue000"), F.lit("\ue000\ue001")), F.lit("\ufffd"), F.lit("\ue000\ue002"))
    valid = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(valid, F.lit("\ue000\ue002"), F.lit("\ufffd")), F.lit("\ue000\ue001"), F.lit("\ue000"))


def strip_control(c: Column, collapse: bool = False) -> Column:
    """Line ends and tabs to spaces, other control and format characters off."""
    c = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\n\r\t", "   "), r"\p{C}", "")
    return strip(F.regexp_replace(c, r"\s+", " ")) if collapse else c


def normalise_key(c: Column) -> Column:
    """What equal paragraphs and questions share: one space for any white space, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def _simple_upper(c: str) -> str:
    """A letter's one-letter capital; itself, if its only capitals are several letters."""
    if c == "ß":
        return "ẞ"
    return next((u for u in (c.upper(), c.title()) if len(u) == 1), c)


_CAPITALS = {c: u for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (u := _simple_upper(c)) != c}


def upper_by_letter(c: Column) -> Column:
    """Capitals letter by letter, as SQL engines of simple case mapping give them: the text keeps its length, where upper() makes SS of ß."""
    return F.translate(c, "".join(_CAPITALS), "".join(_CAPITALS.values()))


def fold_homoglyphs(c: Column) -> Column:
    return F.translate(c, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def foreign_count(c: Column) -> Column:
    """Cyrillic letters and schwas."""
    return F.regexp_count(c, F.lit("[Ѐ-ӿəƏ]"))


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def diacritic_count(c: Column, charset: str = DIACRITICS) -> Column:
    """By what is left without them, which needs no pattern."""
    return F.length(c) - F.length(F.translate(c, charset, ""))


def diacritic_ratio(c: Column, charset: str = DIACRITICS) -> Column:
    """Share of letters in a set; 0 without letters."""
    return F.when(letter_count(c) > 0, diacritic_count(c, charset) / letter_count(c)).otherwise(F.lit(0.0))


# --- slugs and titles ---------------------------------------------------------------------------------


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slugify(c: Column, max_len: int | None = None) -> Column:
    return _dashed(c) if max_len is None else F.substring(_dashed(c), 1, max_len)


def path_slug(c: Column, max_len: int = 60) -> Column:
    """The last three segments below the root, without a document extension; "doc" if nothing is left."""
    parts = F.filter(F.slice(F.split(c, "/"), 2, 1_000_000), lambda s: s != "")
    tail = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), 3)
    name = F.regexp_replace(F.array_join(tail, "-"), r"(?i)\.(md|markdown|rst|mdx)$", "")
    slug = F.substring(_dashed(name), 1, max_len)
    return F.when(slug == "", F.lit("doc")).otherwise(slug)


def title_slug(c: Column, max_len: int = 48) -> Column:
    """Turkish letters to ASCII, parentheses off, cut, no dash at the end."""
    plain = F.regexp_replace(F.lower(F.translate(c, *_TURKISH)), r"[()]", "")
    return F.regexp_replace(F.substring(_dashed(plain), 1, max_len), r"^-+|-+$", "")


def doc_title(text: Column, fallback: Column, max_len: int = 120) -> Column:
    """The first line that is not empty, heading marks off, else the fallback."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: strip(F.regexp_replace(strip(s), r"^#+", ""))), lambda s: s != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, max_len), fallback)


def cve_id(folder: Column) -> Column:
    """An upper-case CVE number in a folder's name, else the folder."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(folder, r"(?i)(CVE-\d{4}-\d+)", 1)), F.lit("")), folder)


# --- filters ------------------------------------------------------------------------------------------


def length_between(c: Column, low: int, high: int | None = None, unit: str = "chars") -> Column:
    n = F.octet_length(c) if unit == "bytes" else F.length(c)
    return (n >= low) if high is None else n.between(low, high)


def instruction_bounds(instruction: Column, response: Column, min_response: int = 10, max_response: int = 1500, max_instruction: int = 600) -> Column:
    i, r = strip(instruction), strip(response)
    return (F.length(i) > 0) & (F.length(i) <= max_instruction) & F.length(r).between(min_response, max_response)


def path_denied(c: Column, fragments: Iterable[str] = DENY_PREPARE) -> Column:
    out = F.lit(False)
    for f in fragments:
        out = out | c.contains(f)
    return out


def path_prefix(c: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    out = F.lit(True)
    include = tuple(include)
    if include:
        out = F.lit(False)
        for p in include:
            out = out | c.startswith(p)
    for p in exclude:
        out = out & ~c.startswith(p)
    return out


def is_readme(c: Column) -> Column:
    """A README that is not the Chinese or Japanese one."""
    low = F.lower(c)
    return low.contains("readme") & ~low.rlike(r"zh|ja")


def is_translation(path: Column, policy: str = "v1") -> Column:
    low = F.lower(path)
    segments = F.split(low, "/")
    among = lambda codes: F.arrays_overlap(segments, F.array(*map(F.lit, codes)))
    if policy == "v1":
        short = F.exists(segments, lambda s: s.rlike(r"^[a-z]{2}([-_][a-z]{2,4})?$") & ~s.isin(list(NOT_LANGUAGES)))
        name = F.regexp_replace(F.element_at(segments, -1), r"\.[^.]*$", "")
        codes = "|".join(sorted(CODES_V1, key=len, reverse=True))
        return among(CODES_V1) | short | name.rlike(rf"[._-]({codes})([._-][a-z]+)?$")
    if policy == "v2":
        return ~among(["en"]) & among(CODES_V2)
    return ~among(["en", "en-us"]) & (among(CODES_V3) | low.rlike("|".join(NAMES_V3)))


def has_nul(content: Column, first: int = 4096) -> Column:
    """Whether binary content, or text, has a NUL byte near its start."""
    return F.position(F.lit(b"\x00"), F.substring(content.cast("binary"), 1, first)) > 0


def non_empty(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.length(F.coalesce(c, F.lit(""))) > 0)
    return out


def command_risk(c: Column) -> Column:
    return c.rlike(RISKY_COMMANDS)


# --- dictionary correction and prompts ----------------------------------------------------------------


def word_pieces(c: Column) -> Column:
    """ASCII words and what stands between them, alternating."""
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))


def dict_correct(c: Column, mapping: Mapping[str, str], keep: Iterable[str] = ()) -> Column:
    """Each ASCII word by its entry, in the word's case, unless it is to be kept."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    kept = list(keep) or [""]

    def fixed(w: Column) -> Column:
        low = F.lower(w)
        to = F.try_element_at(table, low)
        cased = F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(to)).when(w.rlike("^[A-Z]"), F.concat(F.upper(F.substring(to, 1, 1)), F.substring(to, 2, 1_000_000))).otherwise(to)
        return F.when(low.isin(kept) | to.isNull(), w).otherwise(cased)

    return F.array_join(F.transform(word_pieces(c), fixed), "")


def _cased(word: str, to: str) -> str:
    if word.upper() == word and len(word) > 1:
        return to.upper()
    return to[:1].upper() + to[1:] if "A" <= word[:1] <= "Z" else to


#: Pieces that an entry can stand for: ASCII words, and what lies between two of them if it is of the two other letters alone of which the lower case is ASCII.
_ENTRY_PIECES = "[A-Za-z]+|(?<![^A-Za-z])[\u0130\u212a]+(?![^A-Za-z])"


def lower_by_letter(c: Column) -> Column:
    """The lower case, letter by letter: of a capital I with a dot it is i, without the combining dot that lower() adds."""
    return F.lower(F.replace(c, F.lit("\u0130"), F.lit("i")))


def _asked_words(df: DataFrame, text_col: str) -> DataFrame:
    """(_t, word): the distinct lower-cased words of each text under its digest, which is taken once for a text, not for each word."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text_col, F.lit(_ENTRY_PIECES), F.lit(0)), lower_by_letter))
    return df.select(F.md5(text_col).alias("_t"), words.alias("_w")).select("_t", F.explode("_w").alias("word"))


def correct_words(df: DataFrame, text_col: str, dictionary: DataFrame, keep: DataFrame | None = None, as_pieces: bool = False) -> DataFrame:
    """`dict_correct` by a table (word, to) of any size: only the entries that a text asks for come to it.

    Distinct words of distinct texts are joined to the dictionary; what a text needs goes back to it under
    its digest, and its words are replaced in one pass. Of entries of one word the least counts; words of
    `keep` (word) stay. With `as_pieces` the column is the array of the text's `word_pieces`, corrected.
    """
    entries = dictionary.where("word IS NOT NULL AND to IS NOT NULL").groupBy("word").agg(F.min("to").alias("to"))
    if keep is not None:
        entries = entries.join(keep.select("word"), "word", "left_anti")
    found = _asked_words(df, text_col).join(entries, "word").groupBy("_t").agg(F.collect_set(F.struct("word", "to")).alias("_e"))

    def replaced(texts: pd.Series, words: pd.Series, to: pd.Series) -> pd.Series:
        out = []
        for text, some, others in zip(texts, words, to, strict=True):
            known = dict(zip(some, others, strict=True)).get if some is not None else None
            fix = lambda p: p if (x := known(p.replace("\u0130", "i").lower())) is None else _cased(p, x)  # noqa: B023, E731
            if known is None:
                out.append(None)  # such rows are not asked for
            elif as_pieces:
                out.append([fix(p) for p in re.findall("[A-Za-z]+|[^A-Za-z]+", text)])
            else:
                out.append(re.sub(_ENTRY_PIECES, lambda m: fix(m[0]), text))  # noqa: B023
        return pd.Series(out, dtype=object)

    replaced.__annotations__ = {"texts": pd.Series, "words": pd.Series, "to": pd.Series, "return": pd.Series}
    fixed = F.pandas_udf(replaced, "array<string>" if as_pieces else "string")
    rows = df.withColumn("_t", F.md5(text_col)).join(found, "_t", "left")
    part = lambda name: F.transform("_e", lambda e: e[name])
    as_it_is = word_pieces(F.col(text_col)) if as_pieces else F.col(text_col)
    return rows.withColumn(text_col, F.when(F.col("_e").isNull(), as_it_is).otherwise(fixed(F.col(text_col), part("word"), part("to")))).select(*df.columns)


def dict_missing(df: DataFrame, columns: Iterable[str], mapping: Mapping[str, str] | DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """(word, n) of lower-cased ASCII words that neither the dictionary, a mapping or a table (word, ...), nor the list of words to keep has."""
    words = [F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z]+"), F.lit(0)) for c in columns]
    counted = df.select(F.explode(F.concat(*words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    listed = df.sparkSession.createDataFrame([(w,) for w in {*keep, *(() if isinstance(mapping, DataFrame) else mapping)}], "word string")
    missing = counted.join(F.broadcast(listed), "word", "left_anti")
    return missing.join(mapping.select("word"), "word", "left_anti") if isinstance(mapping, DataFrame) else missing


def correct_if_covered(df: DataFrame, columns: Sequence[str], mapping: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """The columns corrected, if every word of theirs is in the dictionary or the list of words to keep; else as they are."""
    keep = list(keep)
    if dict_missing(df, columns, mapping, keep).take(1):
        return df
    return df.withColumns({c: dict_correct(F.col(c), mapping, keep) for c in columns})


def render_prompt(instruction: Column, given: Column) -> Column:
    head, middle, last = PROMPT_HEADERS
    given = strip(F.coalesce(given, F.lit("")))
    return F.concat(F.lit(head), strip(instruction), F.when(given != "", F.concat(F.lit(middle), given)).otherwise(F.lit("")), F.lit(last))


def truncate_note(c: Column, limit: int = 1800) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("\n… ["), (F.length(c) - limit).cast("string"), F.lit(" karakter kesildi]"))).otherwise(c)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tokens(c: Column) -> Column:
    """ASCII letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z0-9_]+"), F.lit(0))
