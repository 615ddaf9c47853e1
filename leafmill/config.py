"""Configuration of fields, parsers and policies; one XML form for it and for an index's header."""

from __future__ import annotations

import copy
import os
from dataclasses import dataclass, field, replace
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from .functions.words import split_words, to_bool, to_int
from .sources import mime

#: Prefix of the built-in field names; Config(prefix=...) sets another.
PREFIX = "leaf"
#: Joins several values of one field, and marks a gap in positions within text.
GAP = "\x03"
MAX_WORD, MIN_WORD = 256, 1
MAX_FILE = 102_400_000

# Property types.
STRING, DATE, INT = 1, 2, 3
_TYPES = {"string": STRING, "text": STRING, "date": DATE, "int": INT}

# Built-in property ids; rank is never stored.
PROPERTY_IDS = {"rank": -1, "filenum": 0, "docpath": 1, "dbfile": 2, "title": 3, "docsize": 4, "lastmodified": 5, "description": 6, "wordnum": 7, "mime": 8, "parser": 9, "encoding": 10}
#: Those that can be asked for without a definition.
_RESOLVED = ("rank", "docpath", "lastmodified", "docsize", "mime", "parser", "wordnum")
_FIRST_PROPERTY, _FIRST_META = 11, 2

_FLAGS = {"Tokenize": "tokenize", "CascadeMetaContext": "cascade", "IgnoreXMLNameSpaces": "ignore_namespaces", "FollowXInclude": "follow_xinclude"}
_POLICIES = {"UndefinedMetaTags": ("undefined_tags", {"index", "error", "ignore", "auto", "autoall"}), "UndefinedXMLAttributes": ("undefined_attributes", {"disable", "error", "ignore", "index", "auto", "autoall"})}
_DEFAULT_FLAGS = {"tokenize": True, "cascade": False, "ignore_namespaces": True, "follow_xinclude": True, "undefined_tags": "index", "undefined_attributes": "disable", "index_script": False}


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass
class MetaName:
    """A searchable field."""

    name: str
    id: int = -1
    bias: int = 0
    alias_for: str | None = None

    @property
    def weight(self) -> int:
        return self.bias if self.bias > 0 else 1


@dataclass
class Property:
    """A stored value."""

    name: str
    id: int = -1
    ignore_case: bool = True
    type: int = STRING
    verbatim: bool = False
    max: int = 0
    sort: bool = True
    presort: bool = True
    sort_length: int = 0
    alias_for: str | None = None


@dataclass
class Config:
    """All settings. Values are plain Python and go to the executors with the parsing stage."""

    prefix: str = PREFIX
    metanames: dict[str, MetaName] = field(default_factory=dict)
    properties: dict[str, Property] = field(default_factory=dict)
    tag_aliases: dict[str, str] = field(default_factory=dict)
    parsers: dict[str, str] = field(default_factory=lambda: dict(mime.PARSERS))
    mimes: dict[str, str] = field(default_factory=mime.defaults)
    index: dict[str, str] = field(default_factory=dict)
    stringlists: dict[str, list[str]] = field(default_factory=dict)
    misc: dict[str, str] = field(default_factory=dict)
    flags: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        p = self.prefix
        self.metanames.setdefault(f"{p}default", MetaName(f"{p}default", 0))
        self.metanames.setdefault(f"{p}title", MetaName(f"{p}title", 1))
        self.properties.setdefault(f"{p}description", Property(f"{p}description", PROPERTY_IDS["description"], sort=False))
        self.properties.setdefault(f"{p}title", Property(f"{p}title", PROPERTY_IDS["title"]))
        self.tag_aliases.setdefault("title", f"{p}title")
        self.tag_aliases.setdefault("body", f"{p}description")

    @property
    def default_meta(self) -> str:
        return f"{self.prefix}default"

    @property
    def title_meta(self) -> str:
        return f"{self.prefix}title"

    def flag(self, name: str):
        return self.flags.get(name, _DEFAULT_FLAGS[name])

    # ---- lookups

    def property_id(self, name: str) -> int:
        """The id of a property; ConfigError if there is none."""
        short = name.removeprefix(self.prefix)
        if name.startswith(self.prefix) and short in _RESOLVED:
            return PROPERTY_IDS[short]
        found = self.properties.get(name)
        if found is None:
            raise ConfigError(f"no such property: {name}")
        if found.alias_for:
            return self.property_id(found.alias_for)
        return found.id

    def meta_target(self, name: str) -> str:
        """The metaname that a name stands for."""
        found = self.metanames[name]
        return found.alias_for or name

    def property_target(self, name: str) -> str:
        found = self.properties[name]
        return found.alias_for or name

    def _free_meta_id(self) -> int:
        return max([_FIRST_META - 1, *(m.id for m in self.metanames.values())]) + 1

    def add_meta(self, name: str, **values) -> MetaName:
        """A new metaname with the next free id."""
        new = MetaName(name, self._free_meta_id(), **values)
        self.metanames[name] = new
        return new

    def add_property(self, name: str, **values) -> Property:
        new = Property(name, max([_FIRST_PROPERTY - 1, *(p.id for p in self.properties.values())]) + 1, **values)
        self.properties[name] = new
        return new

    # ---- reading

    @classmethod
    def read(cls, source: str, prefix: str = PREFIX) -> Config:
        """A configuration from a file or from XML text."""
        return cls(prefix).add(source)

    def add(self, source: str, within: tuple[str, ...] = ()) -> Config:
        """Read XML from a file or text on top of this configuration; `within` are the files that include it."""
        if source.lstrip().startswith("<"):
            text, path = source, None
        else:
            with open(source, encoding="utf-8") as f:
                text, path = f.read(), source
            within = (*within, os.path.realpath(path))
        root = _tree(text)
        for node in root.children:
            self._section(node, path, within)
        self._set_flags()
        self.check()
        return self

    def _section(self, node: _Node, path: str | None, within: tuple[str, ...] = ()) -> None:
        kind = node.local
        if kind == "MetaNames":
            for n in node.children:
                self._read_meta(n)
        elif kind == "PropertyNames":
            for n in node.children:
                self._read_property(n)
        elif kind == "Parsers":
            for n in node.children:
                self.parsers |= {m: n.name for m in split_words(n.text)}
        elif kind == "MIME":
            self.mimes |= {n.name: n.text.strip() for n in node.children}
        elif kind == "Index":
            self.index |= {n.name: n.text.strip() for n in node.children}
        elif kind == "TagAlias":
            for n in node.children:
                self.tag_aliases |= {a.lower(): n.name for a in split_words(n.text)}
        elif kind == "IncludeConfigFile":
            other = node.text.strip()
            if not os.path.isabs(other):
                if path is None:
                    raise ConfigError(f"cannot resolve {other} without a file")
                other = os.path.join(os.path.dirname(path), other)
            if os.path.realpath(other) in within:
                raise ConfigError(f"{other} includes itself")
            self.add(other, within)
        elif kind == "XMLClassAttributes":
            self.stringlists.setdefault(kind, []).extend(w.lower() for w in split_words(node.text))
        else:
            self.misc[kind] = node.text.strip()

    def _read_meta(self, node: _Node) -> None:
        name, values = node.name.lower(), {}
        for k, v in node.attrs.items():
            if k == "bias":
                values["bias"] = to_int(v)
            elif k == "id":
                values["id"] = to_int(v)
                other = next((m.name for m in self.metanames.values() if m.id == values["id"] and m.name != name), None)
                if other in (self.default_meta, self.title_meta):
                    self.metanames[other].id = self._free_meta_id()
                elif other:
                    raise ConfigError(f"id {v} of {name} belongs to {other}")
            elif k == "alias_for":
                values["alias_for"] = v.lower()
            elif not k.startswith("xmlns"):
                raise ConfigError(f"unknown metaname attribute: {k}")
        if name not in self.metanames:
            given = values.pop("id", None)
            meta = self.add_meta(name, **values)
            if given is not None:
                meta.id = given
        else:
            self.metanames[name] = replace(self.metanames[name], **values)
        for alias in split_words(node.text):
            alias = alias.lower()
            if alias == name:  # a name for itself says nothing
                continue
            meta = self.metanames.get(alias) or self.add_meta(alias, bias=self.metanames[name].bias)
            meta.alias_for = name

    def _read_property(self, node: _Node) -> None:
        name, values = node.name.lower(), {}
        for k, v in node.attrs.items():
            if k in ("ignore_case", "verbatim", "sort", "presort"):
                values[k] = to_bool(v)
            elif k in ("max", "sort_length", "id"):
                values[k] = to_int(v)
            elif k == "type":
                if v not in _TYPES and to_int(v) not in _TYPES.values():
                    raise ConfigError(f"unknown property type: {v}")
                values[k] = _TYPES.get(v) or to_int(v)
            elif k == "alias_for":
                values[k] = v.lower()
            elif not k.startswith("xmlns"):
                raise ConfigError(f"unknown property attribute: {k}")
        if name in self.properties:
            self.properties[name] = replace(self.properties[name], **values)
        else:
            given = values.pop("id", None)
            prop = self.add_property(name, **values)
            if given is not None:
                prop.id = given
        own = self.properties[name]
        for alias in split_words(node.text):
            alias = alias.lower()
            if alias == name:
                continue
            if alias in self.properties and self.properties[alias].alias_for != name:
                raise ConfigError(f"{alias} is a property already and cannot stand for {name}")
            if alias not in self.properties:
                self.add_property(alias, ignore_case=own.ignore_case, type=own.type, verbatim=own.verbatim, max=own.max, sort=own.sort, alias_for=name)

    def _set_flags(self) -> None:
        for tag, flag in _FLAGS.items():
            if tag in self.misc:
                self.flags[flag] = to_bool(self.misc[tag])
        for tag, (flag, known) in _POLICIES.items():
            if tag in self.misc:
                if self.misc[tag] not in known:
                    raise ConfigError(f"unknown value of {tag}: {self.misc[tag]}")
                self.flags[flag] = self.misc[tag]

    def check(self) -> None:
        """Every alias must have a target that is defined, and ids must be unique."""
        for kind in (self.metanames, self.properties):
            seen: dict[int, str] = {}
            for x in kind.values():
                if x.alias_for is not None and x.alias_for not in kind:
                    raise ConfigError(f"{x.name} stands for {x.alias_for}, which is not defined")
                if x.id in seen:
                    raise ConfigError(f"{x.name} and {seen[x.id]} have the same id {x.id}")
                seen[x.id] = x.name

    # ---- merging and writing

    def copy(self) -> Config:
        return copy.deepcopy(self)

    def merge(self, other: Config) -> Config:
        """This configuration with the other's settings on top; flags only where the other sets them."""
        out, new = self.copy(), other.copy()
        for name, meta in new.metanames.items():
            if name not in out.metanames and any(m.id == meta.id for m in out.metanames.values()):
                out.add_meta(name, bias=meta.bias, alias_for=meta.alias_for)
            else:
                out.metanames[name] = meta if name not in out.metanames else replace(meta, id=out.metanames[name].id)
        for name, prop in new.properties.items():
            if name not in out.properties and any(p.id == prop.id for p in out.properties.values()):
                prop = replace(prop, id=max(p.id for p in [*out.properties.values(), Property("", _FIRST_PROPERTY - 1)]) + 1)
            elif name in out.properties:
                prop = replace(prop, id=out.properties[name].id)
            out.properties[name] = prop
        for k in ("tag_aliases", "parsers", "mimes", "index", "misc", "flags"):
            getattr(out, k).update(getattr(new, k))
        for k, words in new.stringlists.items():
            out.stringlists[k] = [*out.stringlists.get(k, []), *words]
        out.check()
        return out

    def delete(self, kind: str, name: str) -> None:
        """Remove an entry of metanames, properties, tag_aliases, parsers, mimes, index, stringlists or misc."""
        del getattr(self, kind)[name]

    def to_xml(self) -> str:
        """The header form: every id and attribute, and MIME types that are not the default ones."""
        out = ['<?xml version="1.0"?>', "<config>", " <MetaNames>"]
        for m in self.metanames.values():
            other = f"alias_for={quoteattr(m.alias_for)}" if m.alias_for else f'bias="{m.bias}"'
            out.append(f'  <{m.name} id="{m.id}" {other}/>')
        out += [" </MetaNames>", " <PropertyNames>"]
        for p in self.properties.values():
            if p.alias_for:
                out.append(f'  <{p.name} id="{p.id}" alias_for={quoteattr(p.alias_for)}/>')
            else:
                out.append(f'  <{p.name} id="{p.id}" ignore_case="{int(p.ignore_case)}" verbatim="{int(p.verbatim)}" type="{p.type}" max="{p.max}" sort="{int(p.sort)}" sort_length="{p.sort_length}" presort="{int(p.presort)}"/>')
        out += [" </PropertyNames>", " <Parsers>"]
        out += [f"  <{p}>{escape(m)}</{p}>" for m, p in self.parsers.items()]
        out += [" </Parsers>", " <MIME>"]
        usual = mime.defaults()
        out += [f"  <{e}>{escape(m)}</{e}>" for e, m in self.mimes.items() if usual.get(e) != m]
        out += [" </MIME>", " <Index>", *(f"  <{k}>{escape(v)}</{k}>" for k, v in self.index.items()), " </Index>", " <TagAlias>"]
        out += [f"  <{t}>{escape(a)}</{t}>" for a, t in self.tag_aliases.items()]
        out.append(" </TagAlias>")
        out += [f" <{k}>{escape(' '.join(map(_quoted, v)))}</{k}>" for k, v in self.stringlists.items()]
        out += [f" <{k}>{escape(v)}</{k}>" for k, v in self.misc.items()]
        return "\n".join([*out, "</config>", ""])

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_xml())


def _quoted(word: str) -> str:
    return f'"{word}"' if any(c.isspace() for c in word) else word


def validate(source: str) -> bool:
    """Whether a file or text can be read as a configuration."""
    try:
        Config.read(source)
    except (ConfigError, ValueError, OSError, expat.ExpatError):
        return False
    return True


@dataclass
class _Node:
    name: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)
    text: str = ""

    @property
    def local(self) -> str:
        return self.name.rsplit(":", 1)[-1]


def _tree(text: str) -> _Node:
    """Elements with their names as written; namespaces are not resolved."""
    stack, top = [], []
    parser = expat.ParserCreate()

    def start(name, attrs):
        node = _Node(name, attrs)
        (stack[-1].children if stack else top).append(node)
        stack.append(node)

    def data(s):
        stack[-1].text += s

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), data
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise ConfigError(f"not well-formed: {e}") from None
    return top[0]
