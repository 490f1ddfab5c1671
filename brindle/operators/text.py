"""Text queries: the simple syntax parsed on the driver, then one boolean column and one relevance column."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import chain
from ..plans.schema import Index, Path, RequestError

_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"(?:~\d+)?|[()|+]|-(?=\S)|(?:\\.|[^\s"()|+])+)')


def parse_simple(text: str, every: bool = False) -> tuple | None:
    """+ and, | or, - not, "phrase", prefix*, fuzzy~n, parentheses, \\ escapes; blanks join by the mode."""
    tokens, at = _TOKEN.findall(text), 0

    def clause() -> tuple | None:
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "-":
            inner = clause() if at < len(tokens) else None
            return ("not", inner) if inner else None
        if token == "(":
            node = either()
            if at < len(tokens) and tokens[at] == ")":
                at += 1
            return node
        if token in (")", "|", "+"):
            return None
        if token.startswith('"'):
            body, _, slop = token[1:].rpartition('"')
            return ("phrase", re.sub(r"\\(.)", r"\1", body), int(slop[1:]) if slop else 0)
        if m := re.fullmatch(r"(.+)~(\d*)", token):
            return ("fuzzy", m[1], min(2, int(m[2] or 2)))
        if token.endswith("*") and not token.endswith("\\*") and len(token) > 1:
            return ("prefix", token[:-1])
        return ("term", re.sub(r"\\(.)", r"\1", token))

    def either() -> tuple | None:
        nonlocal at
        node = None
        how = "and" if every else "or"
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at] in ("|", "+"):
                how = "or" if tokens[at] == "|" else "and"
                at += 1
                continue
            right = clause()
            if right is not None:
                node = right if node is None else (how, node, right)
            how = "and" if every else "or"
        return node

    return either()


_FULL = re.compile(
    r'''\s*("(?:[^"\\]|\\.)*"(?:~\d+)?(?:\^[\d.]+)?|/(?:[^/\\]|\\.)*/|[\[{][^\]}]*?\s+TO\s+[^\]}]*[\]}](?:\^[\d.]+)?|[()](?:\^[\d.]+)?|&&|\|\||[+!-](?=\S)|[\w./]+:(?=\S)|(?:\\.|[^\s"()\[\]{}^:\\])+(?:\^[\d.]+)?)'''
)


def parse_full(text: str, every: bool = False) -> tuple | None:
    """The full syntax: field:, AND OR NOT && || ! + -, wildcards, fuzzy~n, "phrase"~n, /regex/, [a TO b], {a TO b}, boost^n, parentheses."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _FULL.match(text, at)
        if not m:
            raise RequestError(f"bad query at {text[at:at + 20]}")
        tokens.append(m[1])
        at = m.end()
    at = 0

    def boosted(token: str, make) -> tuple:
        m = re.fullmatch(r"(.*)\^([\d.]+)", token, re.S)
        return ("boost", float(m[2]), make(m[1])) if m and not token.endswith("\\^") else make(token)

    def atom(token: str) -> tuple:
        if token.startswith('"'):
            body, _, slop = token[1:].rpartition('"')
            return ("phrase", re.sub(r"\\(.)", r"\1", body), int(slop[1:] or 0) if slop else 0)
        if token.startswith("/"):
            return ("regex", token[1:-1].replace("\\/", "/"))
        if token[0] in "[{":
            low, high = re.split(r"\s+TO\s+", token[1:-1].strip())
            return ("range", None if low == "*" else low, None if high == "*" else high, token[0] == "[", token[-1] == "]")
        if m := re.fullmatch(r"(.+)~(\d*)(?:\.\d+)?", token):
            return ("fuzzy", m[1], min(2, int(m[2] or 2)))
        bare = re.sub(r"\\.", "", token)
        if bare != "*" and re.fullmatch(r"[^*?]+\*", bare) and "\\" not in token:
            return ("prefix", token[:-1])
        if "*" in bare or "?" in bare:
            return ("wild", token)
        return ("term", re.sub(r"\\(.)", r"\1", token))

    def clause() -> tuple | None:
        nonlocal at
        token = tokens[at]
        at += 1
        if token in ("-", "!", "NOT"):
            if at >= len(tokens):
                raise RequestError("nothing to negate")
            inner = clause()
            return ("not", inner) if inner else None
        if token == "+":
            return ("must", clause()) if at < len(tokens) else None
        if re.fullmatch(r"[\w./]+:", token):
            if at >= len(tokens):
                raise RequestError(f"nothing to look for in {token[:-1]}")
            inner = clause()
            return ("in", token[:-1].replace(".", "/"), inner) if inner else None
        if token.startswith("("):
            node = either()
            if at >= len(tokens) or not tokens[at].startswith(")"):
                raise RequestError("a parenthesis is open")
            end = tokens[at]
            at += 1
            return ("boost", float(end[2:]), node) if len(end) > 2 and node else node
        return boosted(token, atom)

    def either() -> tuple | None:
        """Required, optional and excluded clauses, as a boolean query takes them."""
        nonlocal at
        must, may, never, how = [], [], [], None
        while at < len(tokens) and not tokens[at].startswith(")"):
            if tokens[at] in ("AND", "&&", "OR", "||"):
                how = "and" if tokens[at] in ("AND", "&&") else "or"
                if how == "and" and may:
                    must.append(may.pop())
                at += 1
                continue
            right = clause()
            if right is not None:
                if right[0] == "not":
                    never.append(right)
                elif right[0] == "must" or how == "and" or (every and how is None):
                    must.append(right[1] if right[0] == "must" else right)
                else:
                    may.append(right)
            how = None
        node = None
        for x in must:
            node = x if node is None else ("and", node, x)
        if not must:
            for x in may:
                node = x if node is None else ("or", node, x)
        else:
            for x in may:  # they count for the score alone
                node = ("should", node, x)
        for x in never:
            node = ("and", node, x) if node else None  # only exclusions match nothing
        return node

    node = either()
    if at < len(tokens):
        raise RequestError("a parenthesis too many")
    return node


def _is(word: str):
    return lambda x: x == word


def one_edit(x: Column, word: str) -> Column:
    """Whether x is at most one edit from word; two neighbours changing places count as one."""
    swapped = [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]
    return (F.levenshtein(x, F.lit(word), 1) >= 0) | (x.isin(swapped) if swapped else F.lit(False))


def _near(word: str, fuzzy: bool):
    return lambda x: one_edit(x, word) if fuzzy else x == word


def _like(pattern: str) -> str:
    """A wildcard pattern as a regular expression."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c.lower())))
        at += 1
    return f"^(?:{''.join(out)})$"


def _once(parts: list[tuple[Path, str | tuple, float]]) -> list[tuple[Path, str | tuple, float]]:
    return list({(p.name, w, b): (p, w, b) for p, w, b in parts}.values())


class TextQuery:
    """Match and score over the searchable leaves of an index; a term matches a document if any field has it."""

    def __init__(self, index: Index, fields: list[str] | None = None, synonyms: dict[str, tuple[dict, dict]] | None = None, weights: dict[str, float] | None = None, full: bool = False):
        self.every = [p for p in index.leaves() if p.leaf.searchable and p.leaf.item == "Edm.String"]
        wanted = {f.lower() for f in fields} if fields else None
        self.paths = self.every[:1] if full else [p for p in self.every if not wanted or p.name.lower() in wanted]
        if not self.paths:
            raise RequestError("no searchable field")
        self.synonyms, self.weights = {k.lower(): v for k, v in (synonyms or {}).items()}, weights or {}
        self._known: dict[tuple, list[str]] = {}

    def tokens(self, path: Path) -> Column:
        run, column = chain(path.leaf.index_analyzer or path.leaf.analyzer), path.column()
        if path.many or path.leaf.collection:
            return F.coalesce(F.flatten(F.transform(F.filter(column, lambda x: x.isNotNull()), run)), F.array().cast("array<string>"))
        return F.coalesce(run(column), F.array().cast("array<string>"))

    def words(self, text: str, path: Path) -> list[str]:
        """The literal's tokens, by the very analyzer that the column has (or the field's for searches)."""
        how = path.leaf.search_analyzer or path.leaf.analyzer
        key = (repr(how), text)
        if key not in self._known:
            self._known[key] = SparkSession.active().range(1).select(chain(how)(F.lit(text))).first()[0] or []
        return self._known[key]

    def variants(self, path: Path, word: str) -> list[list[str]]:
        """The token sequences a word stands for under the field's synonym maps."""
        out = {(word,)}
        for name in path.leaf.synonyms:
            expand, replace = self.synonyms.get(name.lower(), ({}, {}))
            for (w, *rest) in list(out):
                if rest:
                    continue
                more = replace.get(w) or expand.get(w)
                if more:
                    out = (out - {(w,)} if w in replace else out) | {tuple(m.split()) for m in more}
        return [list(v) for v in sorted(out)]

    def field(self, name: str) -> Path:
        found = next((p for p in self.every if p.name.lower() == name.lower()), None)
        if found is None:
            raise RequestError(f"{name} is not searchable")
        return found

    def pruned(self, node: tuple | None, paths: list[Path] | None = None) -> tuple | None:
        """The query without terms that analysis leaves nothing of, as stop words."""
        paths = paths or self.paths
        if node is None:
            return None
        if node[0] in ("and", "or", "should"):
            a, b = self.pruned(node[1], paths), self.pruned(node[2], paths)
            if a and b:
                return (node[0], a, b)
            rest = a or b
            return None if rest is not None and rest[0] == "not" and node[0] == "and" and a is None and node[1][0] != "not" else rest
        if node[0] == "not":
            inner = self.pruned(node[1], paths)
            return ("not", inner) if inner else None
        if node[0] in ("in", "boost"):
            inner = self.pruned(node[2], [self.field(node[1])] if node[0] == "in" else paths)
            return (*node[:2], inner) if inner else None
        if node[0] in ("term", "phrase") and not any(self.words(node[1], p) for p in paths):
            return None
        return node

    def match(self, node: tuple | None) -> Column:
        node = self.pruned(node)
        return F.lit(False) if node is None else self._match(node, self.paths)

    def _match(self, node: tuple, paths: list[Path]) -> Column:
        kind = node[0]
        if kind in ("and", "or"):
            a, b = self._match(node[1], paths), self._match(node[2], paths)
            return a & b if kind == "and" else a | b
        if kind == "should":
            return self._match(node[1], paths)
        if kind == "not":
            return ~self._match(node[1], paths)
        if kind == "in":
            return self._match(node[2], [self.field(node[1])])
        if kind == "boost":
            return self._match(node[2], paths)
        hits = [self.leaf(node, p) for p in paths]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    def leaf(self, node: tuple, path: Path) -> Column:
        tokens, kind = self.tokens(path), node[0]
        if kind == "prefix":
            return F.exists(tokens, lambda t: t.startswith(node[1].lower()))
        if kind == "fuzzy":
            word = node[1].lower()
            return F.exists(tokens, lambda t: one_edit(t, word) if node[2] == 1 else F.levenshtein(t, F.lit(word), node[2]) >= 0)
        if kind == "wild":
            pattern = _like(node[1])
            return F.size(tokens) > 0 if node[1] == "*" else F.exists(tokens, lambda t: t.rlike(pattern))
        if kind == "regex":
            return F.exists(tokens, lambda t: t.rlike(f"^(?:{node[1]})$"))
        if kind == "range":
            low, high = (x.lower() if x else None for x in node[1:3])

            def inside(t: Column) -> Column:
                out = F.lit(True)
                if low is not None:
                    out = out & (t >= low if node[3] else t > low)
                if high is not None:
                    out = out & (t <= high if node[4] else t < high)
                return out

            return F.exists(tokens, inside)
        words = self.words(node[1], path)
        if not words:
            return F.lit(False)
        if kind == "phrase" or len(words) > 1:
            return self.run_of(tokens, words, node[2] if kind == "phrase" else 0)
        out = F.lit(False)
        for v in self.variants(path, words[0]):
            out = out | (F.array_contains(tokens, v[0]) if len(v) == 1 else self.run_of(tokens, v))
        return out

    @staticmethod
    def run_of(tokens: Column, words: list[str], slop: int = 0) -> Column:
        """Whether the words stand in a row, or with shifts from that of slop in all."""
        return F.get(F.transform(F.array(tokens), lambda t: TextQuery._run(t, words, slop)), 0)  # tokens are computed once, not at every place

    @staticmethod
    def _run(tokens: Column, words: list[str], slop: int) -> Column:
        n = len(words)
        if slop:
            begin = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(words), i + 1)), lambda i: i.isNotNull())
            begin = F.array_distinct(F.flatten(F.transform(begin, lambda i: F.sequence(i - n - slop + 1, i))))

            def here(s: Column) -> Column:
                out = F.lit(True)
                for i, w in enumerate(words):
                    first = F.greatest(F.lit(1), s + i)
                    out = out & F.array_contains(F.slice(tokens, first, F.greatest(F.lit(0), s + i + slop - first + 1)), w)
                return out

            return F.exists(begin, here)
        want = F.array(*map(F.lit, words))
        return F.when(F.size(tokens) >= n, F.exists(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, F.lit(n)) == want)).otherwise(F.lit(False))

    def scored(self, node: tuple | None, paths: list[Path] | None = None, boost: float = 1.0) -> list[tuple[Path, str | tuple, float]]:
        """(field, word, boost) for all that scores by counts; for what matches by a pattern, the node in the place of the word."""
        paths = paths or self.paths
        if node is None or node[0] == "not":
            return []
        if node[0] in ("and", "or", "should"):
            return _once(self.scored(node[1], paths, boost) + self.scored(node[2], paths, boost))
        if node[0] == "in":
            return self.scored(node[2], [self.field(node[1])], boost)
        if node[0] == "boost":
            return self.scored(node[2], paths, boost * node[1])
        if node[0] not in ("term", "phrase"):
            return [(p, node, boost) for p in paths]
        out = []
        for p in paths:
            words = self.words(node[1], p)
            if node[0] == "term" and len(words) == 1:
                words = [w for v in self.variants(p, words[0]) for w in v]
            out += [(p, w, boost) for w in words]
        return _once(out)

    def score(self, df: DataFrame, node: tuple | None, how: str = "tfidf") -> Column:
        """Relevance as a column. Document counts of the terms come from one aggregation over df: as many values as the query has terms."""
        parts = self.scored(self.pruned(node))
        if not parts:
            return F.lit(1.0)
        named = {p.name: p for p, _, _ in parts}
        words = list(dict.fromkeys((p.name, w) for p, w, _ in parts if isinstance(w, str)))
        number = {n: k for k, n in enumerate(named)}
        rows = df.select(*(self.tokens(p).alias(f"t{number[n]}") for n, p in named.items()))
        stats = [F.count("*").alias("n"), *(F.avg(F.size(f"t{k}")).alias(f"len{k}") for k in number.values())]
        stats += [F.count_if(F.array_contains(f"t{number[n]}", w)).alias(f"df{j}") for j, (n, w) in enumerate(words)]
        s = rows.agg(*stats).first()
        total = F.lit(0.0)
        for p, w, boost in parts:
            weight = boost * float(self.weights.get(p.name, 1.0))
            if not isinstance(w, str):
                total = total + F.when(self.leaf(w, p), weight).otherwise(0.0)
                continue
            tokens = self.tokens(p)
            length = F.size(tokens)
            tf = F.size(F.filter(tokens, _is(w))).cast("double")
            d = s[f"df{words.index((p.name, w))}"]
            if how == "bm25":
                idf = F.log(F.lit(1 + (s["n"] - d + 0.5) / (d + 0.5)))
                part = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / F.lit(float(s[f"len{number[p.name]}"] or 1))))
            else:
                idf = 1 + F.log(F.lit(s["n"] / (d + 1)))
                part = F.when(length > 0, F.sqrt(tf) * idf * idf / F.sqrt(length.cast("double"))).otherwise(0.0)
            total = total + part * weight
        return total


def highlight(column: Column, words: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with each of the words marked where it stands whole."""
    pattern = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    mark = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(column, rf"(?i)(?<![\p{{L}}\p{{N}}])({pattern})(?![\p{{L}}\p{{N}}])", f"{mark(before)}$1{mark(after)}")


def fragments(path: Path, words: list[str], most: int = 5, before: str = "<em>", after: str = "</em>", size: int = 100) -> Column:
    """At most so many pieces of the field's text, about size characters each and cut at blanks, that hold a word, marked; null without any."""
    column = path.column()
    texts = F.filter(column, lambda x: x.isNotNull()) if path.many or path.leaf.collection else F.array(column)
    pieces = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(rf"(?s)\S.{{0,{size - 1}}}(?=\s|$)|\S+"), F.lit(0))))
    found = F.filter(F.transform(pieces, lambda t: highlight(t, words, before, after)), lambda t: F.contains(t, F.lit(before)))
    return F.when(F.size(found) > 0, F.slice(found, 1, most))


_SPLIT = r"[ \t\n\r,;:.!?\"()\[\]{}]+"


def typed_terms(text: str) -> list[str]:
    return [t.lower() for t in re.split(_SPLIT, text) if t]


def suggest_match(columns: list[Column], text: str, fuzzy: bool = False) -> Column:
    """Every typed term but the last is a whole word of some source field (or one edit away), the last one a prefix."""
    terms = typed_terms(text)
    words = [F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), _SPLIT), lambda t: t != "") for c in columns]

    def any_field(test: Callable[[Column], Column]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.exists(w, test)
        return out

    out = F.lit(bool(terms))
    for t in terms[:-1]:
        out = out & any_field(_near(t, fuzzy))
    if terms:
        out = out & any_field(lambda x: x.startswith(terms[-1]))
    return out


def marked_suggestion(text: Column, typed: str, before: str, after: str) -> Column:
    """The suggestion with the whole words that were typed marked, and of the last one as much as was typed."""
    terms = typed_terms(typed)
    if not terms:
        return text
    edge = r"(?<![^ \t\n\r,;:.!?\"()\[\]{}])"
    whole = [re.escape(t) + r"(?=[ \t\n\r,;:.!?\"()\[\]{}]|$)" for t in sorted(set(terms[:-1]), key=len, reverse=True)]
    mark = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"(?i){edge}({'|'.join([*whole, re.escape(terms[-1])])})", f"{mark(before)}$1{mark(after)}")


def query_plus_text(typed: str, completion: Column) -> Column:
    """What was typed up to its last blank, and the completion."""
    return F.concat(F.lit(typed[: typed.rfind(" ") + 1]), completion)


def completions(df: DataFrame, column: Column, text: str, mode: str = "oneTerm") -> DataFrame:
    """(completion, n): distinct lower-cased words with the typed prefix; twoTerms adds the next word, oneTermWithContext wants the words before it."""
    terms = typed_terms(text)
    if not terms:
        raise RequestError("nothing to complete")
    words = F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = df.select(words.alias("w")).select("w", F.posexplode("w").alias("i", "word")).where(F.col("word").startswith(terms[-1]))
    if mode == "oneTermWithContext" and len(terms) > 1:
        n = len(terms) - 1
        rows = rows.where((F.col("i") >= n) & (F.slice("w", F.col("i") - n + 1, F.lit(n)) == F.array(*map(F.lit, terms[:-1]))))
    follow = F.try_element_at("w", F.col("i") + 2)
    done = F.concat_ws(" ", "word", follow) if mode == "twoTerms" else F.col("word")
    return rows.select(done.alias("completion")).groupBy("completion").agg(F.count("*").alias("n"))
