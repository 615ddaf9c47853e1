"""The query language: parsing to a tree, and the tree as one aggregation over postings.

    a b            either (the default); AND, OR, NOT, XOR in any letter case; ( )
    "a b"          phrase, within one value of one field
    foo*           words that start so
    field:a        in one field; without one, in the default and the title field
    prop:lo..hi    stored value within bounds, both included
    U:uri D:YYYYMMDD M:YYYYMM Y:YYYY T:epoch   exact document terms

Every leaf of the tree becomes a bit; postings and stored values give rows
(document, bits), one aggregation ORs them, and the tree is an expression over
the bits. However many leaves there are, documents are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INT, Config, ConfigError
from ..functions.words import fold_case

BITS = 62
_WORDS = regex.compile(r"[\p{Alphabetic}\p{Nd}'_]+")
#: Exact document terms and the columns that hold them.
EXACT = {"U": "uri", "T": "mtime", "D": "day", "M": "month", "Y": "year"}


class QueryError(ValueError):
    """A query that cannot be parsed."""


@dataclass(frozen=True)
class Term:
    field: str | None
    word: str


@dataclass(frozen=True)
class Wild:
    field: str | None
    start: str


@dataclass(frozen=True)
class Phrase:
    field: str | None
    words: tuple[str, ...]


@dataclass(frozen=True)
class Range:
    prop: str
    low: str
    high: str


@dataclass(frozen=True)
class Exact:
    kind: str
    value: str


@dataclass(frozen=True)
class Op:
    """AND, OR, XOR or NOT (the first without the second, or all without the one)."""

    kind: str
    args: tuple


Node = Term | Wild | Phrase | Range | Exact | Op


def split_text(text: str) -> list[str]:
    """Words of query text by the rules of the tokens."""
    return [w for w in (m.strip("'_") for m in _WORDS.findall(fold_case(text))) if w]


_LEX = regex.compile(r"\s*(?:(?P<paren>[()])|(?P<field>[^\s()\":]+):(?=\S)|\"(?P<quoted>[^\"]*)\"?|(?P<word>[^\s()\"]+))")


def _lex(text: str, config: Config) -> list[tuple[str, str, str | None]]:
    """(kind, text, field) of each token."""
    out, at, fieldname = [], 0, None
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if m is None:
            raise QueryError(f"cannot read query at {text[at:at + 20]!r}")
        name = m["field"]
        if name is not None:
            key = name.lower()
            if fieldname is None and (key in config.metanames or _is_range(text[m.end():]) and _is_property(key, config) or name in EXACT):
                fieldname, at = name if name in EXACT else key, m.end()
                continue
            # a colon that names no field belongs to the word
            m = regex.compile(r"\s*(?P<word>[^\s()\"]+)").match(text, at)
            out.append(("word", m["word"], fieldname))
        elif m["paren"]:
            out.append(("paren", m["paren"], fieldname))
        elif m["quoted"] is not None:
            out.append(("quoted", m["quoted"], fieldname))
        else:
            out.append(("word", m["word"], fieldname))
        fieldname, at = None, m.end()
    return out


def _is_range(rest: str) -> bool:
    return ".." in rest.split(None, 1)[0] if rest.strip() else False


def _is_property(name: str, config: Config) -> bool:
    try:
        config.property_id(name)
    except ConfigError:
        return False
    return True


def parse(text: str, config: Config) -> Node | None:
    """The tree of a query; None for one without any word."""
    tokens = _lex(text, config)
    at = 0

    def word_of(i: int) -> str | None:
        return tokens[i][1].upper() if i < len(tokens) and tokens[i][0] == "word" and tokens[i][2] is None else None

    def leaf() -> Node | None:
        nonlocal at
        kind, value, name = tokens[at]
        if kind == "paren" and value == "(":
            at += 1
            inner = either()
            if at < len(tokens) and tokens[at][:2] == ("paren", ")"):
                at += 1
            return _in_field(inner, name)
        if kind == "paren":
            raise QueryError("unbalanced parenthesis")
        at += 1
        if name in EXACT:
            return Exact(name, value)
        if name is not None and ".." in value and _is_property(name, config):
            low, _, high = value.partition("..")
            found = config.properties.get(name)
            if found is None or found.type != INT or _number(low) is not None and _number(high) is not None:
                return Range(name, low, high)
        if name is not None and name not in config.metanames:
            name, value = None, f"{name}:{value}"
        if kind == "word" and value.endswith("*") and len(value) > 1:
            words = split_text(value)
            if len(words) == 1:
                return Wild(name, words[0])
        words = split_text(value)
        if not words:
            return None
        return Term(name, words[0]) if len(words) == 1 else Phrase(name, tuple(words))

    def unary() -> Node | None:
        nonlocal at
        if word_of(at) == "NOT":
            at += 1
            inner = unary() if at < len(tokens) else None
            return Op("NOT", (None, inner)) if inner is not None else None
        if at >= len(tokens):
            raise QueryError("query ends early")
        return leaf()

    def both() -> Node | None:
        nonlocal at
        left = unary()
        while word_of(at) in ("AND", "NOT"):
            kind = word_of(at)
            at += 1
            if kind == "AND" and word_of(at) == "NOT":
                kind = "NOT"
                at += 1
            right = unary()
            if left is None or right is None:
                left = left if left is not None else right if kind == "AND" else None
            else:
                left = Op(kind, (left, right))
        return left

    def one_of() -> Node | None:
        nonlocal at
        left = both()
        while word_of(at) == "XOR":
            at += 1
            right = both()
            left = Op("XOR", (left, right)) if left is not None and right is not None else left if right is None else right
        return left

    def either() -> Node | None:
        nonlocal at
        found = []
        while at < len(tokens) and tokens[at][:2] != ("paren", ")"):
            if word_of(at) == "OR":
                at += 1
                if at >= len(tokens):
                    raise QueryError("query ends early")
            got = one_of()
            if got is not None:
                found.append(got)
        return None if not found else found[0] if len(found) == 1 else Op("OR", tuple(found))

    tree = either()
    if at < len(tokens):
        raise QueryError("unbalanced parenthesis")
    return tree


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _in_field(node: Node | None, name: str | None) -> Node | None:
    """A field in front of a group is that of all its leaves that have none."""
    if name is None or node is None:
        return node
    if isinstance(node, Op):
        return Op(node.kind, tuple(_in_field(a, name) for a in node.args))
    return type(node)(name, *list(vars(node).values())[1:]) if isinstance(node, (Term, Wild, Phrase)) and node.field is None else node


def limit(prop: str, low: str, high: str) -> Range:
    """A bound on a stored value, to be ANDed to a query."""
    return Range(prop.lower(), low, high)


def with_limits(tree: Node | None, limits: list[str]) -> Node | None:
    """The query with limits `prop low high` ANDed to it."""
    from ..functions.words import split_words

    for text in limits:
        words = split_words(text)
        if len(words) != 3:
            raise QueryError(f"a limit has three words: {text}")
        tree = limit(*words) if tree is None else Op("AND", (tree, limit(*words)))
    return tree


def leaves(node: Node | None) -> list[Node]:
    """Distinct leaves in order."""
    if node is None:
        return []
    if not isinstance(node, Op):
        return [node]
    return list(dict.fromkeys(x for a in node.args for x in leaves(a)))


def truth(node: Node | None, value: Callable[[Node], object], false, negate):
    """The tree over the values of its leaves; works for booleans and for columns."""
    if node is None:
        return false
    if not isinstance(node, Op):
        return value(node)
    args = [truth(a, value, false, negate) if a is not None else None for a in node.args]
    if node.kind == "NOT":
        return negate(args[1]) if args[0] is None else args[0] & negate(args[1])
    out = args[0]
    for a in args[1:]:
        out = out & a if node.kind == "AND" else out | a if node.kind == "OR" else (out & negate(a)) | (negate(out) & a)
    return out


@dataclass
class Tables:
    """What is searched: documents (uri, ...), postings (uri, meta, term, pos, ...), stored values (uri, name, idx, value).

    `words` may hold the documents with the words of their pieces, which narrowed() reads.
    """

    config: Config
    docs: DataFrame
    postings: DataFrame
    props: DataFrame | None = None
    stem: Callable[[str], str] | None = None
    words: DataFrame | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        """The columns that documents go by."""
        return ("uri",)

    def narrowed(self, query: str | Node | None, folder: str) -> Tables:
        """The same for one query: documents and the words that it asks for, written to a folder.

        Texts are split into words once, however often documents and postings are
        read then. Phrases need the places of words and leave the tables as they are.
        """
        tree = parse(query, self.config) if isinstance(query, str) else query
        asked = [x for x in leaves(tree) if isinstance(x, (Term, Wild))]
        if self.words is None or self.stem or not asked or any(isinstance(x, Phrase) for x in leaves(tree)):
            return self

        def wanted(w: Column) -> Column:
            out = F.lit(False)
            for x in asked:
                out = out | (w == x.word if isinstance(x, Term) else w.startswith(x.start))
            return out

        found = F.flatten(F.transform("words", lambda p: F.transform(F.filter(p["words"], wanted), lambda w: F.struct(p["meta"].alias("meta"), w.alias("term")))))
        rows = self.words.withColumn("found", found).select(*self.docs.columns, "found")
        rows.write.parquet(folder)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(folder)
        return replace(self, docs=rows.drop("found"), postings=rows.select("uri", F.inline("found")), words=None)

    def term_rows(self, condition: Column) -> DataFrame:
        """(keys, meta, term, tf) of postings; a row may stand for several places."""
        return self.postings.where(condition).select(*self.keys, "meta", "term", F.lit(1).alias("tf"))

    def with_uri(self, rows: DataFrame) -> DataFrame:
        return rows

    def corpus(self) -> DataFrame:
        """One row: how many documents there are, and their mean number of words."""
        return self.docs.agg(F.count("*").alias("n_docs"), F.avg("nwords").alias("avg_words"))

    def document_counts(self, counted: dict[Node, int]) -> DataFrame:
        """One row: how many documents have each leaf, as df and its number."""
        # an OR of the leaves, so that none is left out by the query
        every = next(iter(counted)) if len(counted) == 1 else Op("OR", tuple(counted))
        order = {x: i for i, x in enumerate(leaves(every))}
        return self.hits(every).agg(*(F.count_if(F.col(f"tf{order[x]}") > 0).alias(f"df{i}") for x, i in counted.items()))

    def field_filter(self, name: str | None) -> Column:
        if name is None:
            return F.col("meta").isin(self.config.default_meta, self.config.title_meta)
        return F.col("meta") == self.config.meta_target(name)

    def _word(self, word: str) -> str:
        return self.stem(word) if self.stem else word

    def leaf_condition(self, leaf: Node) -> Column:
        """Which postings count for a term or wildcard."""
        which = F.col("term") == self._word(leaf.word) if isinstance(leaf, Term) else F.col("term").startswith(leaf.start)
        return which & self.field_filter(leaf.field)

    def phrase_starts(self, leaf: Phrase) -> DataFrame:
        """(uri, meta, start): where all words of a phrase stand in a row.

        Each place of word i votes for a start i before it; a start with a vote
        of each word is a match. One aggregation, however long the phrase is.
        """
        words = [self._word(w) for w in leaf.words]
        place = F.array(*(F.when(F.col("term") == w, F.lit(i)) for i, w in enumerate(words)))
        rows = self.postings.where(F.col("term").isin(sorted(set(words))) & self.field_filter(leaf.field))
        rows = rows.select("uri", "meta", "pos", F.explode(F.filter(place, lambda x: x.isNotNull())).alias("i"))
        seen = {f"seen{at}": F.bit_or(F.when(F.col("i").between(at, at + BITS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") - at)).otherwise(F.lit(0).cast("long"))) for at in range(0, len(words), BITS)}
        starts = rows.groupBy("uri", "meta", (F.col("pos") - F.col("i")).alias("start")).agg(*(c.alias(n) for n, c in seen.items()))
        for at in range(0, len(words), BITS):
            starts = starts.where(F.col(f"seen{at}") == (1 << min(BITS, len(words) - at)) - 1)
        return starts.drop(*seen)

    def range_condition(self, leaf: Range) -> Column:
        """Which stored values lie within bounds: integers as numbers, the rest as strings."""
        prop = self.config.properties.get(leaf.prop)
        value = F.col("value")
        if prop is not None and prop.type == INT:
            return value.try_cast("double").between(float(leaf.low), float(leaf.high))
        if prop is not None and prop.type != INT and prop.type == 1 and prop.ignore_case:
            return F.lower(value).between(leaf.low.lower(), leaf.high.lower())
        return value.between(leaf.low, leaf.high)

    def weight(self) -> Column:
        """How much a word of the row's field counts."""
        weights = {m.name: m.weight for m in self.config.metanames.values()}
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("meta")), F.lit(1)).cast("long")

    def _property_rows(self, name: str) -> DataFrame:
        """(keys, value) of one property, from the stored values or a built-in column of docs."""
        short = name.removeprefix(self.config.prefix)
        column = {"docpath": "uri", "lastmodified": "mtime", "docsize": "size", "mime": "mime", "parser": "parser", "wordnum": "nwords"}.get(short) if name not in self.config.properties else None
        if column is not None:
            return self.docs.select(*self.keys, F.col(column).cast("string").alias("value"))
        target = self.config.property_target(name)
        return self.props.where(F.col("name") == target).select(*self.keys, "value")

    def hits(self, tree: Node | None) -> DataFrame:
        """(keys, bits0, ..., tf0, ...): documents that match; a tf is the weighted count of a leaf, bits tell which leaves are there."""
        found = leaves(tree)
        bit = {x: i for i, x in enumerate(found)}
        words = range((max(1, len(found)) + BITS - 1) // BITS)
        weight = self.weight()
        counted = [x for x in found if isinstance(x, (Term, Wild, Phrase))]
        zero = F.lit(0).cast("long")
        tf_names = [f"tf{bit[x]}" for x in counted]

        def row(source: DataFrame, there: dict[Node, Column | None], tfs: dict[Node, Column]) -> DataFrame:
            """Rows with the bits of the leaves that are there, where their condition holds if they have one."""
            bits = [zero for _ in words]
            for x, c in there.items():
                one = F.lit(1 << bit[x] % BITS).cast("long")
                bits[bit[x] // BITS] = bits[bit[x] // BITS].bitwiseOR(one if c is None else F.when(c, one).otherwise(zero))
            return source.select(*self.keys, *(b.alias(f"bits{i}") for i, b in enumerate(bits)), *(tfs.get(x, zero).alias(f"tf{bit[x]}") for x in counted))

        parts = []
        conditions = {x: self.leaf_condition(x) for x in found if isinstance(x, (Term, Wild))}
        if conditions:
            wanted = None
            for c in conditions.values():
                wanted = c if wanted is None else wanted | c
            parts.append(row(self.term_rows(wanted), conditions, {x: F.when(c, weight * F.col("tf")).otherwise(zero) for x, c in conditions.items()}))
        for x in found:
            if isinstance(x, Phrase):
                parts.append(row(self.phrase_starts(x), {x: None}, {x: weight}))
            elif isinstance(x, Range):
                parts.append(row(self._property_rows(x.prop).where(self.range_condition(x)), {x: None}, {}))
            elif isinstance(x, Exact):
                parts.append(row(self.docs.where(F.col(EXACT[x.kind]).cast("string") == x.value), {x: None}, {}))
        if tree is None:
            return self.docs.select(*self.keys, zero.alias("bits0")).limit(0)
        if truth(tree, lambda _: False, False, lambda v: not v):
            parts.append(row(self.docs, {}, {}))  # documents without any leaf match too
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        merged = rows.groupBy(*self.keys).agg(*(F.bit_or(f"bits{i}").alias(f"bits{i}") for i in words), *(F.sum(n).alias(n) for n in tf_names))
        matches = truth(tree, lambda x: F.col(f"bits{bit[x] // BITS}").bitwiseAND(F.lit(1 << bit[x] % BITS)) != 0, F.lit(False), lambda c: ~c)
        return merged.where(matches)

    def search(self, query: str | Node | None, limits: list[str] | None = None) -> DataFrame:
        """(uri) of the documents that match."""
        tree = parse(query, self.config) if isinstance(query, str) else query
        return self.with_uri(self.hits(with_limits(tree, limits or []))).select("uri")
