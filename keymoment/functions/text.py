"""Text column functions. Patterns keep to what Java's, RE2's and Python's expressions have in common."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of lower-case Latin letters with their marks, or digits.
WORD = "[0-9a-zà-ỹ]+"

#: Words of speech and its openings that carry no topic.
STOP_WORDS = (
    "và", "của", "có", "là", "được", "cho", "với", "các", "những", "này", "đó",
    "một", "trong", "khi", "đã", "sẽ", "cũng", "như", "để", "từ", "tại", "về",
    "người", "nhiều", "rất", "thì", "mà", "nên", "vì", "nếu", "hay", "hoặc",
    "chương", "trình", "quý", "vị", "kính", "chào", "xin", "mời", "theo", "dõi",
    "hôm", "nay", "ngày", "tháng", "năm", "sau", "đây", "tin", "tức", "thông",
    "the", "and", "for", "with", "that", "this", "you", "are", "was",
)

#: Words of titles, keywords and descriptions that carry no topic.
METADATA_STOP_WORDS = (
    "và", "của", "các", "những", "cho", "với", "trong", "tại", "được", "là", "có", "đã", "sẽ",
    "một", "này", "đó", "khi", "như", "ra", "vào", "lại", "về", "đến", "từ", "tìm", "thấy", "cảnh", "video",
    "màu", "đỏ", "vàng", "xanh", "trắng", "đen", "hồng", "cam", "tím", "nâu", "xám",
    "xe", "người", "con", "cái", "chiếc", "ảnh", "hình", "đang", "nhiều", "hai", "ba", "bốn",
    "red", "yellow", "blue", "green", "white", "black", "pink", "orange", "purple", "brown", "gray",
    "car", "cat", "dog", "person", "woman", "man", "and", "the", "with", "from", "for", "photo", "image", "clip", "full", "tap", "tập", "hd",
)

#: Words of a query that are left out before its phrases are made, and words of fields that have no frequency of their own.
FIELD_QUERY_STOP_WORDS = (
    "và", "là", "có", "trong", "đang", "của", "cho", "với", "những", "các", "trên", "tại", "một", "ở", "ra", "vào",
    "được", "bị", "khi", "để", "màu", "cảnh", "video",
)
FIELD_STOP_WORDS = (
    "và", "của", "các", "những", "cho", "với", "trong", "tại", "được", "là", "có", "đã", "sẽ",
    "một", "này", "đó", "khi", "như", "ra", "vào", "lại", "về", "đến", "từ", "tìm", "thấy", "cảnh", "video",
    "màu", "đang", "nhiều", "hai", "ba", "bốn", "gì", "ở", "bên", "trên", "dưới", "giữa", "theo", "sau", "trước",
    "a", "an", "the", "in", "on", "at", "to", "for", "with", "from", "of", "and",
)

#: Names of events and places that count as one word in metadata.
METADATA_PHRASES = (
    "đua xe đạp", "cúp truyền hình", "truyền hình tp hcm", "chợ bến thành", "cầu rồng", "vịnh hạ long",
    "ngoại hạng anh", "bản tin thời sự", "thời sự", "vòng chung kết", "thành phố hồ chí minh",
    "hà nội", "đà nẵng", "sầm sơn", "tam kỳ", "huế", "đà lạt", "quảng trường thống nhất",
    "lan tỏa năng lượng tích cực", "món ngon mỗi ngày", "thế giới động vật", "phim hoạt hình",
    "múa lân", "lễ hội", "ca nhạc", "trao giải", "hội nghị",
)

#: Characters outside the blocks in which NFC changes nothing: Latin letters with their marks made one, common punctuation, Han.
MAY_CHANGE = r"[^\u0000-\u02ff\u1e00-\u1eff\u2002-\u20cf\u4e00-\u9fff]"


@F.pandas_udf(T.StringType())
def _normal_form(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(x: Column) -> Column:
    """Unicode NFC. Spark has no function for it; only texts with a character that it may change are sent to Python."""
    return F.coalesce(_normal_form(F.when(x.rlike(MAY_CHANGE), x)), x)


def folded(x: Column) -> Column:
    """NFC, then lower case: a letter and its mark must be one before words are cut."""
    return F.lower(nfc(x))


@F.pandas_udf(T.StringType())
def without_marks(x: pd.Series) -> pd.Series:
    """Letters without their marks (NFKD), đ as d."""
    return x.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D"), na_action="ignore")


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def plain_words(x: Column) -> Column:
    """The folded text's words with one blank between."""
    return F.array_join(F.regexp_extract_all(folded(x), F.lit(WORD), F.lit(0)), " ")


def field_query_words(x: Column) -> Column:
    """A query's words of two letters or more, commas, full stops and semicolons taken out, without FIELD_QUERY_STOP_WORDS."""
    return F.filter(F.split(F.translate(F.lower(x), ",.;", "   "), r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(*FIELD_QUERY_STOP_WORDS))


def is_stop(w: Column) -> Column:
    return w.isin(*STOP_WORDS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression that a column function uses several times is else computed each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(x: Column) -> Column:
    """Of the folded text's words of two letters or more: those that aren't stop words, then pairs a_b of neighbours unless both are."""
    return folded_tokens(folded(x))


def folded_tokens(x: Column) -> Column:
    """tokens() of a text that is folded already; no Python, so rows stay dealt as they are."""

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.when(~(is_stop(a) & is_stop(b)), F.concat_ws("_", a, b)))
        return F.concat(F.filter(w, lambda t: ~is_stop(t)), F.array_compact(pairs))

    return let(F.regexp_extract_all(x, F.lit(f"{WORD[:-1]}{{2,}}"), F.lit(0)), of)


def metadata_tokens(x: Column, compounds: tuple[str, ...] = METADATA_PHRASES) -> Column:
    """Distinct words of three letters or more that aren't stop words of metadata, in order, then the compounds the text has."""
    low = folded(x)
    one = F.filter(F.regexp_extract_all(low, F.lit(f"{WORD[:-1]}{{3,}}"), F.lit(0)), lambda t: ~t.isin(*METADATA_STOP_WORDS))
    return F.array_distinct(F.concat(one, compound_phrases(low, compounds)))


def compound_phrases(x: Column, phrases: tuple[str, ...]) -> Column:
    """Those of the phrases that stand in the text, each as one word, in the order given."""
    low = F.lower(x)
    found = [F.when(F.contains(low, F.lit(p)), p.replace(" ", "_")) for p in phrases]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def any_prefix(x: Column, prefixes: str) -> Column:
    """Whether x starts with one of a comma list."""
    out = F.lit(False)
    for p in prefixes.split(","):
        if p.strip():
            out = out | x.startswith(p.strip())
    return out


def sanitise(x: Column) -> Column:
    """A field of an answer file: commas, quotes and line ends are spaces, white space is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, '[,\\r\\n"]+', " "), "\\s+", " "))


def csv_name(x: Column) -> Column:
    return F.concat(F.regexp_replace(x, "[.][^.]*$", ""), F.lit(".csv"))


def task_of(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("trake")), "trake").when(low.rlike("qa|q&a|vqa"), "qa").otherwise("kis")


def clean_answer(x: Column) -> Column:
    """Lower case, without punctuation at words, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[.,;:!?\"']", ""), "\\s+", " "))


def short_answer(x: Column, most: int = 200) -> Column:
    """An answer without a leading `answer:`, quotes around it and a last point; at most `most` letters."""
    y = F.regexp_replace(F.trim(x), "^(?i)(the answer is|answer|đáp án|trả lời)\\s*[:\\-]?\\s*", "")
    y = F.regexp_replace(y, "^[\"'“”]+|[\"'“”]+$", "")
    return F.substring(F.regexp_replace(F.trim(y), "[.]+$", ""), 1, most)


def entropy(x: Column) -> Column:
    """Shannon entropy of a text's letters, in bits."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        p = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda y: y == c)) / n)
        return F.aggregate(p, F.lit(0.0), lambda s, v: s - v * F.log2(v))

    return let(F.filter(F.split(x, ""), lambda c: c != ""), of)


def minutes(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def deep_link(url: Column, seconds: Column, before: int = 2) -> Column:
    return F.concat(url, F.lit("&t="), F.greatest(F.floor(seconds) - before, F.lit(0)).cast("string"), F.lit("s"))


def video_key(url: Column) -> Column:
    """The eleven letters after v= or the last slash of a watch address."""
    return F.regexp_extract(url, "(?:v=|/)([0-9A-Za-z_-]{11})(?:[?&#]|$)", 1)


def question_of(x: Column) -> Column:
    """The last sentence that ends with a question mark."""
    return F.trim(F.regexp_extract(x, "([^.!?]*[?])[^?]*$", 1))


def reduced_query(x: Column, fillers: tuple[str, ...] = ("the video shows", "a scene of", "there is", "there are", "we can see", "in the video", "in the scene", "the camera", "find the moment", "please", "cảnh", "đoạn video")) -> Column:
    """A query without filler phrases; fewer than three words left: as it was."""
    y = F.lower(x)
    for f in fillers:
        y = F.regexp_replace(y, f, " ")
    y = F.trim(F.regexp_replace(y, "\\s+", " "))
    return F.when(F.size(F.split(y, " ")) < 3, x).otherwise(y)


def first_time(x: Column) -> Column:
    """Whether a text asks for the first occurrence."""
    return F.lower(x).rlike("first time|for the first|lần đầu|đầu tiên")


def quota_error(x: Column) -> Column:
    return F.lower(x).rlike("quota|rate.?limit|429|resource.?exhausted|too many requests")


#: Colours by name; the order is that of a query's words.
COLOURS = ("red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "white", "black", "gray")


#: The same colours in Vietnamese.
COLOURS_VI = {"red": "đỏ", "orange": "cam", "yellow": "vàng", "green": "xanh lá", "blue": "xanh dương", "purple": "tím", "pink": "hồng", "brown": "nâu", "white": "trắng", "black": "đen", "gray": "xám"}


def colour_in_vietnamese(c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in COLOURS_VI.items()])


def colours_in(x: Column) -> Column:
    w = words(x)
    return F.filter(F.array(*map(F.lit, COLOURS)), lambda c: F.array_contains(w, c))


def colour_class(r: Column, g: Column, b: Column) -> Column:
    """A colour's name by hue, saturation and value of 0..255 channels."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = (hi - lo).cast("double")
    v, s = hi / 255.0, F.when(hi == 0, 0.0).otherwise(span / hi)
    hue = F.when(span == 0, 0.0).when(hi == r, 60 * F.pmod((g - b) / span, F.lit(6.0))).when(hi == g, 60 * ((b - r) / span + 2)).otherwise(60 * ((r - g) / span + 4))
    return F.when(v < 0.2, "black").when((s < 0.15) & (v > 0.85), "white").when(s < 0.15, "gray").when((hue < 15) | (hue >= 345), "red").when(hue < 40, "orange").when(hue < 70, "yellow").when(hue < 170, "green").when(hue < 260, "blue").when(hue < 300, "purple").otherwise("pink")


def term_count(x: Column, term: str) -> Column:
    """How many of a thing a text names: a number or number word up to two words before it, else 1; 0 if it isn't named."""
    low = F.lower(x)
    n = F.regexp_extract(low, f"([0-9]+|one|two|three|four|five|six)(?: [a-z]+)? {term}", 1)
    value = F.coalesce(*[F.when(n == w, i + 1) for i, w in enumerate(("one", "two", "three", "four", "five", "six"))], F.expr("1") * F.when(n != "", n.try_cast("int")))
    return F.when(~low.rlike(f"(^|[^a-z]){term}"), 0).otherwise(F.coalesce(value, F.lit(1)))


def context_line(texts: Column, labels: Column) -> Column:
    """`Visible text: a | b; label: count` lines for a reader of the picture."""
    return F.concat_ws("; ", F.when(F.size(texts) > 0, F.concat(F.lit("Visible text: "), F.concat_ws(" | ", texts))), F.when(F.size(labels) > 0, F.concat(F.lit("Objects: "), F.concat_ws(", ", labels))))


# --- functions that need a parser


_MARKERS = re.compile(r"\b(?:E|Event|Sự kiện|Cảnh)\s*(\d+)\s*[:.)-]\s*", re.I)
_STRONG = re.compile(r"\s*(?:;|\bthen\b|\bafter that\b|\bnext\b|\bfinally\b|\bsau đó\b|\btiếp theo\b|\bcuối cùng\b)\s*,?\s*", re.I)
_LIST = re.compile(r"^(.*?):\s*(.+)$", re.S)
_NUMBERED = re.compile(r"(?:^|\s)\(?\d+[.)]\s+")


def split_events(text: str) -> tuple[list[str], str]:
    """(events, shape): by markers, by numbers, by a colon's list, by connectors, else the text alone."""
    text = re.sub(r"\s+", " ", text or "").strip()
    if not text:
        return [], "empty"
    if len(_MARKERS.findall(text)) > 1:
        parts = [p.strip(" ,;.") for p in _MARKERS.split(text)[2::2]]
        return [p for p in parts if p], "markers"
    if len(_NUMBERED.findall(text)) > 1:
        return [p for p in (p.strip(" ,;.") for p in _NUMBERED.split(text)[1:]) if p], "numbers"
    m = _LIST.match(text)
    if m and "," in m[2]:
        parts = [p.strip(" .") for p in re.split(r",|;", m[2]) if p.strip(" .")]
        if len(parts) > 1:
            return parts, "list"
    parts = [p.strip(" ,;.") for p in _STRONG.split(text) if p.strip(" ,;.")]
    return (parts, "connectors") if len(parts) > 1 else ([text], "whole")


@F.pandas_udf(T.ArrayType(T.StringType()))
def events_of(x: pd.Series) -> pd.Series:
    return x.map(lambda s: split_events(s)[0])


def tolerant_object(raw: str) -> dict | None:
    """The first JSON object of a reply: fences, text around it and trailing commas are allowed."""
    raw = re.sub(r"```[a-z]*", "", raw or "")
    start = raw.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(raw)):
            c = raw[i]
            if skip:
                skip = False
            elif c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    try:
                        out = json.loads(re.sub(r",\s*([}\]])", r"\1", raw[start : i + 1]))
                        return out if isinstance(out, dict) else None
                    except ValueError:
                        break
        start = raw.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def json_object(x: pd.Series) -> pd.Series:
    """The object as normal JSON text, or null."""
    return x.map(lambda s: None if (o := tolerant_object(s)) is None else json.dumps(o, ensure_ascii=False, sort_keys=True), na_action="ignore")


def pack_sentences(text: str, most: int = 58, count=lambda s: len(s.split())) -> list[str]:
    """Sentences packed into chunks of `most` tokens; a longer sentence is cut at commas, then by words."""
    parts: list[str] = []
    for s in re.split(r"(?<=[.!?;])\s+", text.strip()):
        for p in [s] if count(s) <= most else re.split(r"(?<=,)\s+", s):
            w = p.split()
            while count(" ".join(w)) > most:
                parts.append(" ".join(w[:most]))
                w = w[most:]
            parts.append(" ".join(w))
    out: list[str] = []
    for p in filter(None, parts):
        if out and count(f"{out[-1]} {p}") <= most:
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks_of(x: pd.Series) -> pd.Series:
    return x.map(lambda s: pack_sentences(s or ""))
