"""Analyzers and normalizers as column functions: char filters on text, tokenizers to arrays, token filters on arrays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import RequestError

#: What a definition sets for one component.
Options = dict

STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
ARTICLES = ["l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu"]


def _folds() -> tuple[str, str]:
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source) + "øØłŁđĐıħĦ", "".join(target) + "oOlLdDihH"


_FROM, _TO = _folds()


def ascii_fold(text: Column) -> Column:
    out = F.translate(text, _FROM, _TO)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def elide(text: Column, articles: list[str] = ARTICLES) -> Column:
    return F.regexp_replace(text, f"(?i)^(?:{'|'.join(map(re.escape, articles))})['’]", "")


NORMALIZERS: dict[str, Callable[[Column], Column]] = {"standard": lambda c: ascii_fold(F.lower(c)), "lowercase": F.lower, "uppercase": F.upper, "asciifolding": ascii_fold, "elision": elide}


def html_strip(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def mapping(pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def run(text: Column) -> Column:
        for a, b in pairs:
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    return run


def _mapping_of(o: Options):
    return mapping([tuple(x.strip() for x in m.split("=>", 1)) for m in o.get("mappings", [])])


CHAR_FILTERS: dict = {"html_strip": lambda o: html_strip, "mapping": _mapping_of, "pattern_replace": lambda o: lambda c: F.regexp_replace(c, str(o.get("pattern", "")), str(o.get("replacement", "")))}

_nonempty = lambda tokens: F.filter(tokens, lambda t: t != "")


def _piece(text: Column, size: int):
    return lambda i: F.substr(text, i, F.lit(size))


def grams(text: Column, low: int, high: int, front: bool = False) -> Column:
    """All substrings of low to high characters (front: those at the start), by length and then place."""
    n = F.length(text)
    parts = []
    for size in range(low, high + 1):
        if front:
            parts.append(F.when(n >= size, F.array(F.substring(text, 1, size))).otherwise(F.array().cast("array<string>")))
        else:
            parts.append(F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), _piece(text, size))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def _extract(pattern: str):
    return lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


_WORD = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"


def _cut(tokens: Column, most: int) -> Column:
    """Tokens longer than most characters in pieces of that length."""

    def parts(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(t) - 1) / most)).cast("int")), lambda i: F.substr(t, i * most + 1, F.lit(most)))

    return F.flatten(F.transform(tokens, parts))


def _sized(pattern: str, default: int = 255):
    def make(o: Options):
        most = int(o.get("maxTokenLength", default))
        if not 1 <= most <= 300:
            raise RequestError("maxTokenLength is 1 to 300")
        return lambda c: _cut(_extract(pattern)(c), most)

    return make


def _path_parts(o: Options):
    by, to, skip, back = str(o.get("delimiter", "/")), str(o.get("replacement", o.get("delimiter", "/"))), int(o.get("skip", 0)), bool(o.get("reverse", False))

    def run(c: Column) -> Column:
        parts = F.filter(F.split(c, re.escape(by)), lambda t: t != "")
        n = F.size(parts) - skip
        steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        lead = F.when(c.startswith(by) & F.lit(not back and not skip), F.lit(to)).otherwise(F.lit(""))
        if back:
            return F.transform(steps, lambda i: F.array_join(F.slice(parts, i, n - i + 1), to))
        return F.transform(steps, lambda i: F.concat(lead, F.array_join(F.slice(parts, F.lit(skip + 1), i), to)))

    return run


def _gram_tokenizer(front: bool):
    def make(o: Options):
        low, high = int(o.get("minGram", 1)), int(o.get("maxGram", 2))
        if not 1 <= low <= high <= 300:
            raise RequestError("grams have 1 to 300 characters")
        return lambda c: grams(c, low, high, front)

    return make


def _pattern_tokenizer(o: Options):
    pattern, group = str(o.get("pattern", r"\W+")), int(o.get("group", -1))
    if group < 0:
        return lambda c: _nonempty(F.split(c, pattern))
    return lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


TOKENIZERS: dict[str, Callable[[Options], Callable[[Column], Column]]] = {
    "standard_v2": _sized(_WORD),
    "classic": _sized(r"[\p{L}\p{N}]+(?:['’.@&-][\p{L}\p{N}]+)*"),
    "uax_url_email": _sized(r"[a-z]+://[^\s]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|" + _WORD),
    "keyword_v2": lambda o: lambda c: F.array(c),
    "letter": lambda o: _extract(r"\p{L}+"),
    "lowercase": lambda o: lambda c: _extract(r"\p{L}+")(F.lower(c)),
    "whitespace": lambda o: lambda c: _nonempty(F.split(c, r"\s+")),
    "pattern": _pattern_tokenizer,
    "path_hierarchy_v2": _path_parts,
    "nGram": _gram_tokenizer(False),
    "edgeNGram": _gram_tokenizer(True),
}
TOKENIZERS["standard"] = TOKENIZERS["standard_v2"]

_each = lambda f: lambda tokens: F.transform(tokens, f)


def shingles(tokens: Column, size: int = 2, unigrams: bool = True, most: int | None = None, by: str = " ") -> Column:
    def of(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), by))
        return F.when(F.size(tokens) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.concat(*([tokens] if unigrams else []), *map(of, range(size, (most or size) + 1)))


def _spread(f: Callable[[Column], Column]):
    """A filter that makes several tokens of one."""
    return lambda tokens: F.flatten(F.transform(tokens, f))


def _maybe(condition: Column, more: Column) -> Column:
    return F.when(condition, F.array(more)).otherwise(F.array().cast("array<string>"))


def light_stem(t: Column) -> Column:
    """English endings by rule, as Porter's first steps take them: plurals, -ed and -ing behind a vowel, -ly and final -y."""
    t = F.regexp_replace(t, "['’]s?$", "")
    for pattern, to in ((r"(ss)es$", "$1"), (r"ies$", "i"), (r"([^s])s$", "$1"), (r"([aeiouy].*(?:at|bl|iz))(?:ing|ed)$", "$1e"), (r"([aeiouy].*?|.*[aeiouy])([bdfgmnprt])\2(?:ing|ed)$", "$1$2"), (r"([aeiouy].*)(?:ingly|edly|ing|ed|ly)$", "$1"), (r"([aeiou].*)y$", "$1i")):
        t = F.regexp_replace(t, pattern, to)
    return t


def _light(*rules: tuple[str, str]):
    def run(t: Column) -> Column:
        for pattern, to in rules:
            t = F.regexp_replace(t, pattern, to)
        return t

    return run


#: Light stemmers by language: inflections at the end of longer words. Others go unstemmed.
STEMMERS: dict[str, Callable[[Column], Column]] = {
    "en": light_stem, "fr": _light((r"(..)eaux$", "$1eau"), (r"(..)aux$", "$1al"), (r"(...)(?:es|s|e|x)$", "$1")), "de": _light((r"(...)(?:ern|em|er|en|es|e|s|n)$", "$1"),),
    "es": _light((r"(...)(?:es|os|as|o|a|e|s)$", "$1"),), "it": _light((r"(...)[aeio]$", "$1"),), "pt-pt": _light((r"(...)(?:ões|ães)$", "$1ão"), (r"(...)(?:es|os|as|o|a|e|s)$", "$1")),
    "nl": _light((r"(...)(?:en|e|s)$", "$1"),), "sv": _light((r"(...)(?:arna|erna|orna|ar|er|or|en|et|a|e)$", "$1"),), "ru": _light((r"(...)(?:ями|ами|ов|ев|ей|ый|ий|ая|ое|ые|ам|ям|ах|ях|а|я|о|е|и|ы|у|ю|ь)$", "$1"),),
}
STEMMERS |= {"pt-br": STEMMERS["pt-pt"], "no": STEMMERS["sv"], "nb": STEMMERS["sv"], "da": STEMMERS["sv"]}
STOP = {
    "en": STOPWORDS, "fr": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me mes moi ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war was wie wir zu zum zur".split(),
    "es": "a al ante como con de del desde donde el ella en entre es esta este la las lo los más me mi no nos o para pero por que se si sin sobre su sus también te tu un una y ya".split(),
    "it": "a al alla che con da dal dei del della di e gli i il in la le lo ma nel non per più se si su un una uno".split(),
}
STOP |= {"pt-pt": "a ao as com como da das de do dos e em na nas no nos não o os ou para pela pelo por que se sem um uma".split(), "nl": "aan als bij dat de den der des die door een en er het ik in is je met niet of om op te van voor was wat ze zijn".split()}
#: Languages with an analyzer of their own, and those that fall back to the standard one.
LANGUAGES = {f"{n}.lucene": n for n in "ar bg ca cs da de el en es eu fa fi fr ga gl hi hu hy id it lv nl no nb pt-br pt-pt ro ru sv tr ckb zh-hans zh-hant ja ko pl th".split()}
CJK = ("zh-hans", "zh-hant", "ja", "ko")
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"


def cjk_bigrams(tokens: Column) -> Column:
    """Runs of ideographs, kana and Hangul as pairs of neighbours; other words as they are."""

    def one(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
        return F.when(t.rlike(f"^[{_CJK}]") & (F.length(t) > 1), pairs).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one))


def _words(o: Options, name: str, default: list[str]) -> list[str]:
    value = o.get(name, default)
    return value.split() if isinstance(value, str) else list(value)


def _stopwords(o: Options):
    listed = str(o.get("stopwordsList", "english"))
    languages = {"english": "en", "french": "fr", "german": "de", "spanish": "es", "italian": "it", "portuguese": "pt-pt", "dutch": "nl"}
    words = _words(o, "stopwords", STOP.get(languages.get(listed, ""), STOPWORDS))
    if o.get("ignoreCase"):
        words = [w.lower() for w in words]
        return lambda a: F.filter(a, lambda t: ~F.lower(t).isin(words))
    return lambda a: F.filter(a, lambda t: ~t.isin(words))


def _keep(o: Options):
    words, fold = _words(o, "keepWords", []), bool(o.get("keepWordsCase", False))
    words = [w.lower() for w in words] if fold else words
    return lambda a: F.filter(a, lambda t: (F.lower(t) if fold else t).isin(words))


def _length(o: Options):
    low, high = int(o.get("min", 0)), int(o.get("max", 300))
    if not 0 <= low <= high <= 300:
        raise RequestError("a length is 0 to 300")
    return lambda a: F.filter(a, lambda t: F.length(t).between(low, high))


def _gram_filter(front: bool, least: int = 1, most: int = 2):
    def make(o: Options):
        low, high = int(o.get("minGram", least)), int(o.get("maxGram", most))
        if not 1 <= low <= high <= 300:
            raise RequestError("grams have 1 to 300 characters")
        if front and o.get("side", "front") == "back":
            return _spread(lambda t: F.transform(grams(F.reverse(t), low, high, True), F.reverse))
        return _spread(lambda t: grams(t, low, high, front))

    return make


def _shingle(o: Options):
    low, high = int(o.get("minShingleSize", 2)), int(o.get("maxShingleSize", 2))
    if not 2 <= low <= high:
        raise RequestError("a shingle has two tokens or more")
    return lambda a: shingles(a, low, bool(o.get("outputUnigrams", True)), high, str(o.get("tokenSeparator", " ")))


def _common_grams(o: Options):
    words, query = _words(o, "commonWords", STOPWORDS), bool(o.get("useQueryMode", False))

    def run(a: Column) -> Column:
        def at(i: Column) -> Column:
            own, after = F.get(a, i), F.get(a, i + 1)
            pair = own.isin(words) | after.isin(words)
            both = F.array(own, F.concat(own, F.lit("_"), after))
            return F.when(after.isNotNull() & pair, F.slice(both, 2, 1) if query else both).otherwise(F.array(own))

        return F.when(F.size(a) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(a) - 1), at))).otherwise(a)

    return run


def _decompound(o: Options):
    words = sorted({w.lower() for w in _words(o, "wordList", [])})
    least, size = int(o.get("minWordSize", 5)), int(o.get("minSubwordSize", 2))

    def one(t: Column) -> Column:
        found = F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: (F.length(w) >= size) & F.contains(F.lower(t), w))
        return F.when(F.length(t) >= least, F.concat(F.array(t), found)).otherwise(F.array(t))

    return _spread(one)


def _word_delimiter(o: Options):
    """Parts at changes of case, between letters and digits, and at other characters; preserveOriginal and catenateAll add the whole."""

    def one(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lo}+|\p{N}+"), F.lit(0))
        out = F.concat(_maybe(F.lit(bool(o.get("preserveOriginal", False))), t), parts, _maybe(F.lit(bool(o.get("catenateAll", False))), F.array_join(parts, "")))
        return F.array_distinct(out)

    return _spread(one)


def _capture(o: Options):
    patterns, keep = list(o.get("patterns", [])), bool(o.get("preserveOriginal", True))

    def one(t: Column) -> Column:
        found = [F.array(t)] if keep else []
        found += [F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)) for p in patterns]
        return F.array_distinct(F.concat(*found)) if found else F.array(t)

    return _spread(one)


def _override(o: Options):
    rules = dict(tuple(x.strip() for x in r.split("=>")) for r in o.get("rules", []))

    def one(t: Column) -> Column:
        out = t
        for a, b in rules.items():
            out = F.when(t == a, F.lit(b)).otherwise(out)
        return out

    return _each(one)


def _synonyms(o: Options):
    expand, replace = synonym_rules("\n".join(o.get("synonyms", [])))

    def one(t: Column) -> Column:
        out = F.array(t)
        for w, others in (expand | replace).items():
            kept = sorted(others if w in replace else others | {w})
            out = F.when(F.lower(t) == w, F.array(*map(F.lit, kept))).otherwise(out)
        return out

    return _spread(one)


def _stem_by(o: Options):
    names = {"english": "en", "lightEnglish": "en", "minimalEnglish": "en", "porter2": "en", "french": "fr", "lightFrench": "fr", "german": "de", "lightGerman": "de", "spanish": "es", "lightSpanish": "es", "italian": "it", "portuguese": "pt-pt", "dutch": "nl", "swedish": "sv", "russian": "ru"}
    name = str(o.get("language", "english"))
    if name not in names:
        raise RequestError(f"no stemmer for {name}")
    return _each(STEMMERS[names[name]])


def _swap(source: str, target: str, gone: str = ""):
    return lambda o: _each(lambda t: F.regexp_replace(F.translate(t, source, target), f"[{gone}]", "") if gone else F.translate(t, source, target))


TOKEN_FILTERS: dict[str, Callable[[Options], Callable[[Column], Column]]] = {
    "lowercase": lambda o: _each(F.lower), "uppercase": lambda o: _each(F.upper), "trim": lambda o: _each(F.trim), "reverse": lambda o: _each(F.reverse),
    "asciifolding": lambda o: _spread(lambda t: F.array_distinct(F.array(ascii_fold(t), t))) if o.get("preserveOriginal") else _each(ascii_fold),
    "elision": lambda o: _each(lambda t: elide(t, _words(o, "articles", ARTICLES))), "apostrophe": lambda o: _each(lambda t: F.regexp_replace(t, "['’].*$", "")),
    "classic": lambda o: _each(lambda t: F.regexp_replace(F.regexp_replace(t, "['’]s$", ""), r"\.(?=\p{L}|$)", "")),
    "truncate": lambda o: _each(lambda t: F.substring(t, 1, int(o.get("length", 300)))), "unique": lambda o: F.array_distinct, "stopwords": _stopwords, "keep": _keep, "length": _length,
    "limit": lambda o: lambda a: F.slice(a, 1, int(o.get("maxTokenCount", 1))), "shingle": _shingle, "edgeNGram": _gram_filter(True), "edgeNGram_v2": _gram_filter(True), "nGram": _gram_filter(False), "nGram_v2": _gram_filter(False),
    "keyword_repeat": lambda o: _spread(lambda t: F.array(t, t)), "keyword_marker": lambda o: lambda a: a, "cjk_bigram": lambda o: cjk_bigrams, "cjk_width": lambda o: _each(lambda t: F.translate(t, "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))),
    "pattern_replace": lambda o: _each(lambda t: F.regexp_replace(t, str(o.get("pattern", r"\W+")), str(o.get("replacement", "")))), "pattern_capture": _capture, "common_grams": _common_grams, "dictionary_decompounder": _decompound,
    "word_delimiter": _word_delimiter, "synonym": _synonyms, "stemmer_override": _override, "stemmer": _stem_by, "snowball": _stem_by, "porter_stem": lambda o: _each(light_stem), "kstem": lambda o: _each(light_stem),
    "german_normalization": lambda o: _each(lambda t: F.replace(F.translate(t, "äöü", "aou"), F.lit("ß"), F.lit("ss"))), "scandinavian_folding": _swap("åäæöøÅÄÆÖØ", "aaaooAAAOO"), "scandinavian_normalization": _swap("äöÄÖ", "æøÆØ"),
    "arabic_normalization": _swap("أإآىة", "ااايه", "\u0640\u064b-\u0652"), "persian_normalization": _swap("یکۀہ", "يكهه"), "sorani_normalization": _swap("يىكہ", "ییکه", "\u0640\u200c"),
    "hindi_normalization": _swap("ऩऱऴ", "नरळ", "\u200c\u200d\u093c"), "indic_normalization": _swap("", "", "\u200c\u200d"),
}

PREDEFINED: dict[str, tuple[str, ...]] = {
    "standard": ("standard_v2", "lowercase", "stopwords"), "standard.lucene": ("standard_v2", "lowercase", "stopwords"), "standardasciifolding.lucene": ("standard_v2", "lowercase", "asciifolding"),
    "keyword": ("keyword_v2",), "pattern": ("pattern", "lowercase"), "simple": ("lowercase",), "stop": ("lowercase", "stopwords"), "whitespace": ("whitespace",),
}


def _component(kinds: dict, name: str | dict, what: str):
    options: Options = name if isinstance(name, dict) else {}
    key = str(options.get("name") or options.get("type")) if options else name
    if key not in kinds:
        raise RequestError(f"unknown {what} {key}")
    return kinds[key](options)


def _language(name: str) -> Callable[[Column], Column]:
    if name in CJK:
        return lambda c: cjk_bigrams(_extract(rf"[{_CJK}]+|[^\W{_CJK}]+")(F.lower(c)))
    parts = ["standard_v2", "lowercase"] + (["elision"] if name in ("fr", "it", "ca", "ga") else [])
    chars = {"ar": "arabic_normalization", "fa": "persian_normalization", "hi": "hindi_normalization", "ckb": "sorani_normalization", "de": "german_normalization"}
    run = chain({"tokenizer": parts[0], "tokenFilters": [*parts[1:], {"name": "stopwords", "stopwords": STOP.get(name, [])}, *([chars[name]] if name in chars else [])]})
    stem = STEMMERS.get(name)
    return (lambda c: F.transform(run(c), stem)) if stem else run


def chain(name: str | dict | None) -> Callable[[Column], Column]:
    """An analyzer as a function of a text column to its tokens.

    name: a predefined analyzer, a language's (those without one of their own fall back to the standard analyzer), or a
    definition: charFilters, tokenizer and tokenFilters, each a name or a dict of name and options; or type
    PatternAnalyzer, StandardAnalyzer or StopAnalyzer with its options. Stemming is light, by rules on word endings.
    """
    if not isinstance(name, dict):
        key = (name or "standard").lower()
        if key in PREDEFINED:
            name = {"tokenizer": PREDEFINED[key][0], "tokenFilters": list(PREDEFINED[key][1:])}
        elif key.endswith(".microsoft") or LANGUAGES.get(key) in ("pl", "th"):
            return chain("standard")
        elif key in LANGUAGES:
            return _language(LANGUAGES[key])
        else:
            raise RequestError(f"unknown analyzer {name}")
    kind = str(name.get("type", "")).rsplit(".", 1)[-1]
    if kind == "PatternAnalyzer":
        name = {"tokenizer": {"name": "pattern", "pattern": name.get("pattern", r"\W+")}, "tokenFilters": (["lowercase"] if name.get("lowercase", True) else []) + [{"name": "stopwords", "stopwords": name.get("stopwords", [])}]}
    elif kind == "StandardAnalyzer":
        name = {"tokenizer": {"name": "standard_v2", "maxTokenLength": name.get("maxTokenLength", 255)}, "tokenFilters": ["lowercase", {"name": "stopwords", "stopwords": name.get("stopwords", [])}]}
    elif kind == "StopAnalyzer":
        name = {"tokenizer": "lowercase", "tokenFilters": [{"name": "stopwords", "stopwords": name.get("stopwords", STOPWORDS)}]}
    if "tokenizer" not in name:
        raise RequestError("an analyzer has a tokenizer")
    chars = [c if callable(c) else _component(CHAR_FILTERS, c, "char filter") for c in name.get("charFilters", ())]
    split = _component(TOKENIZERS, name["tokenizer"], "tokenizer")
    filters = [f if callable(f) else _component(TOKEN_FILTERS, f, "token filter") for f in name.get("tokenFilters", ())]

    def run(text: Column) -> Column:
        for c in chars:
            text = c(text)
        tokens = split(text)
        for f in filters:
            tokens = f(tokens)
        return tokens

    return run


analyzer = chain


def normalizer(name: str | dict) -> Callable[[Column], Column]:
    """A normalizer by name or definition: char filters, then token filters on the whole text."""
    if isinstance(name, dict):
        if "tokenizer" in name:
            raise RequestError("a normalizer has no tokenizer")
        run = chain({"tokenizer": "keyword_v2", **name})
        return lambda c: F.get(run(c), 0)
    if name not in NORMALIZERS:
        raise RequestError(f"unknown normalizer {name}")
    return NORMALIZERS[name]


def synonym_rules(text: str) -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    """(expanding, replacing) rules from lines `a, b, c` and `a, b => c`."""
    expand: dict[str, set[str]] = {}
    replace: dict[str, set[str]] = {}
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        terms = lambda s: {t.strip().lower() for t in s.split(",") if t.strip()}
        if "=>" in line:
            left, right = line.split("=>")
            for t in terms(left):
                replace.setdefault(t, set()).update(terms(right))
        else:
            for t in terms(line):
                expand.setdefault(t, set()).update(terms(line))
    return expand, replace
