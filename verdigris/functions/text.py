"""Scalar text, identity and arithmetic functions, all evaluated in the JVM unless named ``*_udf``."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a secret, as sensitive, as talk about the process, and as a plan for the next chapter.
SECRET_PATTERNS = (
    r"(?i)\bauthorization\s*:\s*\S+",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"(?i)\b(?:api[_ -]?key|access[_ -]?token|refresh[_ -]?token|client[_ -]?secret|password|passwd|cookie|private[_ -]?key|weread_api_key)\b\s*[:=]\s*\S+",
    r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"\bsk-[A-Za-z0-9_-]{12,}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
)
SENSITIVE = r"(?i)(api[ _-]?key|access[ _-]?token|authorization|credential|secret|password|密钥|密码|令牌)"
PROCESS_TALK = r"(?i)(验收|体验可用|节点\s*\d|跳过.{0,6}讨论|流程.{0,8}通过|skill|同步.{0,8}成功|导入.{0,8}成功)"
NEXT_READING = (r"重读", r"(?i)(?:阅读|读)(?:.{0,16})(?:章节|第.{1,8}[章节回部篇]|ch-\d+)", r"(?i)(?:章节|第.{1,8}[章节回部篇]|ch-\d+)(?:.{0,16})(?:阅读|读)")
#: The forms of a chapter heading, and what no heading ends with.
NUMERALS = "0-9０-９零〇一二三四五六七八九十百千万两壹贰叁肆伍陆柒捌玖拾佰仟"
HEADINGS = (
    rf"第\s*[{NUMERALS}]+\s*[章节回卷部篇集幕](?:\s*[：:、.．\-—]?\s*.{{0,60}})?",
    rf"[卷部篇集]\s*[{NUMERALS}]+(?:\s*[：:、.．\-—]?\s*.{{0,60}})?",
    r"(序章|序言|前言|楔子|引子|引言|后记|尾声|终章|结语|跋|附录(?:\s*[一二三四五六七八九十0-9]+)?)(?:\s*[：:、.．\-—]?\s*.{0,50})?",
    r"(chapter|part|book)\s+[0-9ivxlcdm]+(?:\s*[：:._\-—]?\s*.{0,60})?",
)
SENTENCE_ENDS = "[。！？；.!?;]$"
#: Texts of these characters alone are in NFKC, and small letters are all that case folding makes of them (but for ß): ASCII, accented Latin letters, Greek and Cyrillic ones, general dashes and quotes, kana, Hangul syllables, CJK ideographs and their own punctuation, pictographs.
STABLE = r"^[\x00-\x7E¡-§©«¬®°±¶·»¿-įĴ-ľŁ-ňŊ-žΑ-Ωα-ρσ-ωА-я–—‘-”、。《-】ぁ-ゔァ-ヺー가-힣一-龥\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6C5}]*$"
#: Characters that NFKC replaces by one other, and some of those that it replaces by several.
SINGLE = {chr(c): n for c in range(0x80, 0xFFFE) if not 0xD800 <= c < 0xE000 and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)}
SEVERAL = {c: unicodedata.normalize("NFKC", c) for c in "…‥ﬀﬁﬂﬃﬄﬅﬆ™½¼¾⅓⅔№℃℉㎏㎡㎝㎜㎞Ⅱ Ⅲ Ⅳ Ⅵ Ⅶ Ⅷ Ⅸ ⅱⅲⅳⅵⅶⅷⅸ①②③⑩⑪⑫".replace(" ", "") if len(unicodedata.normalize("NFKC", c)) > 1}
#: What a book without ratings says, and how raters are counted.
NO_RATING, RATERS = "暂无评分", "（%s 人评分）"
#: Claims of whole coverage, and what is said in their place.
SCOPE_CLAIMS = (
    ("逐字读完", "未逐字覆盖"), ("逐章读完", "未获得章节级完整覆盖"), ("完整覆盖所有内容", "仅覆盖已准备的相关证据"),
    ("全部章节覆盖", "仅覆盖已准备的相关证据"), ("全书100%", "不代表全书覆盖"), ("全书 100%", "不代表全书覆盖"),
)
SCOPES = ("discussion", "read-for-me", "recommendation")
LOCATOR = r"^[0-9a-f]{64}#ch-[0-9]{3}:p-[0-9]{4}$"


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def clean_display(x: Column) -> Column:
    """Each line's runs of blanks become one space, ends are trimmed, empty lines go."""
    lines = F.transform(F.split(x, "\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(line, "[\\t\\f\\x0B ]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def nfkc_characters(x: Column) -> Column:
    """NFKC of each character by itself, but for rare ligatures and squared letters: for headings and names, inside of lambdas too."""
    out = F.translate(x, "".join(SINGLE), "".join(SINGLE.values()))
    for c, several in SEVERAL.items():
        out = F.replace(out, F.lit(c), F.lit(several))
    return F.when(F.rlike(x, F.lit(STABLE)), x).otherwise(out)


def folded(x: Column) -> Column:
    """NFKC and case folding. Texts that are in NFKC as they are stay in the JVM; of the others alone the characters go through Arrow."""
    stable = F.rlike(x, F.lit(STABLE))
    return F.when(stable, _lowered(x)).otherwise(folded_udf(F.when(~stable, x)))


def _lowered(x: Column) -> Column:
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normalize_search(x: Column) -> Column:
    """NFKC, case folding, no white space."""
    return F.regexp_replace(folded(x), "(?U)[\\s\\x1C-\\x1F]+", "")


def strip_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, "[\\p{P}\\p{S}]", "")


def _letters_and_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^\\p{L}\\p{N}]+", "")


def normalize_key(x: Column) -> Column:
    """NFKC, case folding, letters and digits alone; null as empty."""
    return _letters_and_digits(folded(F.coalesce(x, F.lit(""))))


def normalize_keys(xs: Column) -> Column:
    """The keys of an array's texts."""
    xs = F.transform(xs, lambda x: F.coalesce(x, F.lit("")))
    stable = F.forall(xs, lambda x: F.rlike(x, F.lit(STABLE)))
    texts = F.when(stable, F.transform(xs, _lowered)).otherwise(folded_all_udf(F.when(~stable, xs)))
    return F.transform(texts, _letters_and_digits)


def title_forms(title: Column) -> Column:
    """The keys of the whole title and of what stands before its first colon."""
    return F.filter(F.array_distinct(F.array(normalize_key(title), normalize_key(F.get(F.split(title, "[：:]", 2), F.lit(0))))), lambda k: k != "")


def authors_match(remote: Column, local: Column) -> Column:
    """Whether either key contains the other, for any local author; an empty name matches nothing."""
    r, keys = normalize_key(remote), normalize_keys(local)
    either = F.zip_with(keys, F.array_repeat(r, F.size(keys)), lambda a, b: (a != "") & (F.contains(b, a) | F.contains(a, b)))
    return F.coalesce((r != "") & F.array_contains(either, True), F.lit(False))


def isbn_digits(identifiers: Column) -> Column:
    """The first identifier that has 10 or 13 digits."""
    digits = F.transform(identifiers, lambda i: F.regexp_replace(i, "\\D", ""))
    return F.get(F.filter(digits, lambda d: F.length(d).isin(10, 13)), F.lit(0))


def locator(book: Column, chapter: Column, paragraph: Column) -> Column:
    return F.format_string("%s#ch-%03d:p-%04d", book, chapter, paragraph)


def excerpt(x: Column, limit: int = 180) -> Column:
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit - 3), F.lit("...")))


def evidence_excerpt(x: Column, limit: int = 2000) -> Column:
    return F.struct(F.substring(x, 1, limit).alias("text"), (F.length(x) > limit).alias("truncated"))


def contains_secret(x: Column) -> Column:
    out = F.lit(False)
    for p in SECRET_PATTERNS:
        out = out | F.rlike(x, F.lit(p))
    return out


def is_heading(x: Column) -> Column:
    """At most 100 characters, no tab, no sentence end, and one of the forms of a chapter heading, all in NFKC."""
    t = F.trim(nfkc_characters(x))
    forms = F.rlike(t, F.lit("(?i)^(?:" + "|".join(f"(?:{p})" for p in HEADINGS) + ")$"))
    return (F.length(t) <= 100) & (t != "") & ~F.contains(t, F.lit("\t")) & ~F.rlike(t, F.lit(SENTENCE_ENDS)) & forms


def literal_count(x: Column, literal: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


#: Decimal digits of all scripts, and what they stand for.
DIGITS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.decimal(chr(c), None) is not None}


def range_start(x: Column) -> Column:
    """The start of ``a-b`` (blanks may stand around either number, digits be of any script), else null."""
    plain = F.translate(x, "".join(DIGITS), "".join(DIGITS.values()))
    return F.when(F.rlike(plain, F.lit("(?U)^\\s*[0-9]+\\s*-\\s*[0-9]+\\s*$")), F.regexp_extract(plain, "(?U)^\\s*([0-9]+)", 1).try_cast("bigint"))


def coverage(done: Column, total: Column) -> Column:
    """Six decimals, half to even; 0 without chapters."""
    return F.when(total > 0, F.bround(done / total, 6)).otherwise(F.lit(0.0))


def proposed_segments(chars: Column, paragraphs: Column, most_chars: int = 80_000, most_paragraphs: int = 800) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / most_chars), F.ceil(paragraphs / most_paragraphs)).cast("int")


def strict_timestamp(x: Column) -> Column:
    """RFC 3339 with a zone; anything else is null, naive times too."""
    return F.when(F.rlike(x, F.lit("(Z|[+-]\\d\\d:\\d\\d)$")), F.try_to_timestamp(x))


def short_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """The prefix and the first hex digits (16 or 24) of the parts' hash."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, digits))


def utc_text(ts: Column) -> Column:
    """UTC to the second, with ``Z`` (the session's zone is taken to be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_time(create_time: Column, synced_at: Column) -> Column:
    """Epoch seconds where they are above zero, else the time of the sync."""
    return F.when(create_time > 0, F.timestamp_seconds(create_time)).otherwise(strict_timestamp(synced_at))


def week_of(ts: Column, minutes: int = 0) -> Column:
    """The ISO week ``YYYY-Www`` in a fixed offset of so many minutes."""
    local = F.timestamp_add("MINUTE", F.lit(minutes), ts)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), local).cast("int"), F.weekofyear(local))


def safe_int(x: Column) -> Column:
    """A whole number, cut towards zero; 0 for what is none."""
    return F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))


def is_one(x: Column) -> Column:
    """The strict kind of truth: true or one."""
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1"), F.lit(False))


def is_truthy(x: Column) -> Column:
    """The loose kind: a number but zero, or a text that says true, yes or 1."""
    said = F.lower(F.btrim(x.cast("string"), F.lit(" \t\n\r\x0b\x0c"))).isin("true", "yes", "1")
    number = F.coalesce(x.cast("string").try_cast("double") != 0, F.lit(False))
    return F.coalesce(said, F.lit(False)) | (F.typeof(x).isin("tinyint", "smallint", "int", "bigint", "float", "double") & number)


def one_decimal(x: Column) -> Column:
    """A number to one decimal without a trailing zero: the nearer one of its exact binary value, the even one of two."""
    size = F.abs(x)
    low = F.floor(size * 10)
    # The distance to the middle between two decimals, exactly: either half of the number has room for a factor of 20.
    high = size.cast("float").cast("double")
    over = (high * 20 - (2 * low + 1)) + (size - high) * 20
    tenths = (low + ((over > 0) | ((over == 0) & (low % 2 == 1))).cast("bigint")).cast("bigint")
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), tenths % 10)).otherwise(F.lit("")))
    return F.concat(F.when(x < 0, "-").otherwise(""), shown)


def rating_text(rating: Column, count: Column) -> Column:
    """A rating out of 100 to one decimal; of 100 to 1000 it is a tenth."""
    number = rating.try_cast("double")
    number = F.when(number > 100, number / 10).otherwise(number)
    return F.when(number.isNull(), NO_RATING).otherwise(F.concat(one_decimal(number), F.lit("/100"), F.when(count.isNotNull(), F.format_string(RATERS, count)).otherwise(F.lit(""))))


def scope_limits(values: Column) -> Column:
    """Claims of whole coverage are replaced by what can be said; each limit once, in order."""
    def one(v: Column) -> Column:
        for claim, limit in SCOPE_CLAIMS:
            v = F.replace(v, F.lit(claim), F.lit(limit))
        return v

    return F.array_distinct(F.transform(values, one))


def claims_too_much(value: Column) -> Column:
    """Whether any string inside a struct, array or map claims whole coverage; names of fields claim nothing."""
    text = F.regexp_replace(F.to_json(value), r'"(?:[^"\\\\]|\\\\.)*"\s*:', "")
    out = F.lit(False)
    for claim, _ in SCOPE_CLAIMS:
        out = out | F.contains(text, F.lit(claim))
    return out


def file_component(x: Column) -> Column:
    """A name that can be part of a path: illegal characters become one ``-``, runs of blanks one space, at most 80 characters."""
    out = F.regexp_replace(nfkc_characters(x), r'[<>:"/\\|?*\x00-\x1F]+', "-")
    return F.substring(F.regexp_replace(F.regexp_replace(out, "\\s+", " "), "^[ .-]+|[ .-]+$", ""), 1, 80)


def locators_in(x: Column) -> Column:
    """All locators that stand in a text, in order."""
    return F.regexp_extract_all(x, F.lit("[0-9a-f]{64}#ch-[0-9]{3}:p-[0-9]{4}"), F.lit(0))


def canonical_scopes(scopes: Column) -> Column:
    """The known scopes among these, each once, in their own order."""
    return F.filter(F.array(*map(F.lit, SCOPES)), lambda s: F.array_contains(scopes, s))


def is_next_reading(x: Column) -> Column:
    return F.rlike(x, F.lit(NEXT_READING[0])) | F.rlike(x, F.lit(NEXT_READING[1])) | F.rlike(x, F.lit(NEXT_READING[2]))


def markdown_sections(x: Column) -> Column:
    """A map from each ``##`` title to its bullets, or to its body where it has none; of a title that stands twice the last counts."""
    blank = F.lit(" \t\n\r\x0b\x0c")
    parts = F.slice(F.split(F.concat(F.lit("\n"), x), "\n##\\s+"), 2, 1_000_000)
    title = lambda part: F.btrim(F.substring_index(part, "\n", 1), blank)
    titles = F.transform(parts, title)
    bullets = lambda body: F.transform(F.filter(F.split(body, "\n"), lambda line: F.startswith(line, F.lit("- "))), lambda line: F.btrim(F.substr(line, F.lit(3)), blank))
    body = lambda part: F.btrim(F.when(F.contains(part, F.lit("\n")), F.substr(part, F.instr(part, "\n") + 1)).otherwise(""), blank)
    values = lambda b: F.when(F.size(bullets(b)) > 0, bullets(b)).when(b != "", F.array(b)).otherwise(F.expr("cast(array() as array<string>)"))
    told = F.transform(parts, lambda part, i: F.when(~F.array_contains(F.slice(titles, i + 2, F.greatest(F.size(titles), F.lit(1))), title(part)), F.struct(title(part).alias("title"), values(body(part)).alias("items"))))
    return F.map_from_entries(F.filter(told, lambda e: e.isNotNull()))


def topic_score(topic: str, text: Column) -> Column:
    """4 for the whole query, 1 for each of its distinct bigrams, by containment."""
    q, t = "".join(_nfkc(topic).casefold().split()), normalize_search(text)
    grams = dict.fromkeys(q[i : i + 2] for i in range(len(q) - 1)) if len(q) > 2 else {}
    score = F.when(F.contains(t, F.lit(q)), 4).otherwise(0) if q else F.lit(0)
    return reduce(lambda n, g: n + F.contains(t, F.lit(g)).cast("int"), grams, score)


def usable_text(x: Column) -> Column:
    return ~F.rlike(x, F.lit("[<>]")) & (F.trim(x) != "") & F.rlike(x, F.lit("[\\p{L}\\p{N}]"))


def _nfkc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFKC", s)


def search_form(s: str) -> str:
    """What ``normalize_search`` makes of a text."""
    return "".join(_nfkc(s).casefold().split())


@F.pandas_udf(T.StringType())
def nfkc_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else _nfkc(s))


@F.pandas_udf(T.StringType())
def folded_udf(x: pd.Series) -> pd.Series:
    """NFKC, then case folding."""
    return x.map(lambda s: None if s is None else _nfkc(s).casefold())


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_all_udf(xs: pd.Series) -> pd.Series:
    return xs.map(lambda a: None if a is None else [_nfkc(s).casefold() for s in a])


@F.pandas_udf(T.StringType())
def norm_search_udf(x: pd.Series) -> pd.Series:
    """NFKC, case folding, no white space."""
    return x.map(lambda s: None if s is None else search_form(s))


@F.pandas_udf(T.StringType())
def norm_key_udf(x: pd.Series) -> pd.Series:
    """NFKC, case folding, letters and digits alone."""
    return x.map(lambda s: None if s is None else re.sub(r"[\W_]+", "", _nfkc(s).casefold()))


@F.pandas_udf(T.DoubleType())
def partial_similarity_udf(query: pd.Series, text: pd.Series) -> pd.Series:
    """The best difflib ratio of the query over windows of the text."""
    from difflib import SequenceMatcher

    def one(q: str, t: str) -> float:
        if not q or not t:
            return 0.0
        width, step = min(len(t), len(q) + max(4, len(q) // 5)), max(1, len(q) // 6)
        starts = sorted({*range(0, len(t) - width + 1, step), len(t) - width})
        return max(SequenceMatcher(None, q, t[s : s + width]).ratio() for s in starts)

    return pd.Series([one(q, t) for q, t in zip(query, text, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def canonical_json_udf(x: pd.Series) -> pd.Series:
    """JSON with sorted keys, compact, other characters kept."""
    import json

    return x.map(lambda s: None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def split_long(s: str, limit: int = 8000) -> list[str]:
    """Pieces of at most ``limit`` characters, cut behind the last sentence mark in the last two fifths, else hard."""
    out, rest = [], s
    while len(rest) > limit:
        ends = [i + 1 for i in range(int(limit * 0.6), limit) if rest[i] in ".!?。！？；;"]
        at = ends[-1] if ends else limit
        out.append(rest[:at].strip())
        rest = rest[at:]
    return [p for p in [*out, rest.strip()] if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_long_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda s: split_long(s or ""))


def register(spark: SparkSession) -> None:
    """Makes the vectorised functions callable from SQL."""
    for name, f in (("norm_search", norm_search_udf), ("norm_key", norm_key_udf), ("partial_similarity", partial_similarity_udf), ("canonical_json", canonical_json_udf), ("split_long", split_long_udf)):
        spark.udf.register(name, f)
