"""Field extraction from HTML, XML and plain text; pure Python, one document at a time.

A reader turns a document into start, end, text and comment events; the
Extractor keeps the stacks of open tags, fields and properties and produces

    properties   name -> values, text of a property tag and of all below it
    metas        name -> values, text of the innermost field
    pieces       (metaname, tag path, text) in document order, for tokenising;
                 GAP characters in a piece are gaps in positions
"""

from __future__ import annotations

import os
import posixpath
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.parsers import expat

from ..config import GAP, Config

# HTML elements that stand within a line, and those without content.
INLINE = set("a abbr acronym applet b basefont bdo big br cite code del dfn em embed font i iframe img input ins kbd label map object q s samp script select small span strike strong sub sup textarea tt u var".split())
VOID = set("area base basefont br col embed frame hr img input isindex link meta param source track wbr".split())
#: Elements that end where another of these starts.
_CLOSED_BY = {"p": set("p div ul ol dl table pre form h1 h2 h3 h4 h5 h6 blockquote hr address fieldset body".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
KNOWN = INLINE | VOID | set("html head title body p div ul ol li dl dt dd table tr td th tbody thead tfoot caption colgroup pre form h1 h2 h3 h4 h5 h6 blockquote address fieldset legend option optgroup style center dir menu noscript noframes frameset button".split())

_XINCLUDE = {"http://www.w3.org/2001/XInclude", "http://www.w3.org/2003/XInclude"}
_COMMAND = re.compile(r"(?:(\w*command)\s*)?(noindex|index)?", re.IGNORECASE)
_TRIM = " \t\n\x0b\x0c\r"
MAX_INCLUDE_DEPTH = 16


class MarkupError(ValueError):
    """A document that the policies refuse."""


@dataclass
class Analysis:
    """What one document gives."""

    properties: dict[str, list[str]] = field(default_factory=dict)
    metas: dict[str, list[str]] = field(default_factory=dict)
    pieces: list[tuple[str, str, str]] = field(default_factory=list)
    encoding: str = "UTF-8"
    warnings: list[str] = field(default_factory=list)
    new_metas: list[str] = field(default_factory=list)
    new_properties: list[str] = field(default_factory=list)
    #: (uri, X for markup or T for plain text) of what is to be included but was not looked for
    includes: list[tuple[str, str]] = field(default_factory=list)


#: Characters of a dotted path of tags that can name a field, if no configured name is longer.
LONGEST_PATH = 512


@dataclass
class _Open:
    raw: str
    name: str
    path: str | None
    ignored: bool = False
    is_property: bool = False
    is_field: bool = False


class Extractor:
    """The state between events."""

    def __init__(self, config: Config, is_html: bool, uri: str = "", depth: int = 0, root: str = "", from_files: bool = True):
        self.config, self.is_html, self.uri, self.depth, self.root, self.from_files = config, is_html, uri, depth, root, from_files
        self.out = Analysis()
        self.dom: list[_Open] = []
        # open elements by tag, and how many are ignored, so that no event looks through the stack
        self.raws: Counter[str] = Counter()
        self.ignored = 0
        self.props: list[_Open] = []
        self.fields = [_Open("", config.default_meta, config.default_meta)]
        self.meta_text = self.prop_text = ""
        self.bump, self.hidden = False, 0
        self.metas, self.properties = set(config.metanames), set(config.properties)
        self.longest = max([LONGEST_PATH, *map(len, (*self.metas, *self.properties, *config.tag_aliases))])
        self.class_attributes = set(config.stringlists.get("XMLClassAttributes", []))

    # ---- events

    def start(self, tag: str, attrs: list[tuple[str, str]], prefix: str | None = None) -> None:
        raw = tag
        name = self._name(tag, prefix)
        if self.is_html:
            self._html_bump(name)
            if name == "meta" and self._html_meta(attrs, prefix):
                return
            ignored = False
        else:
            self.bump = True
            name = self._attributes(name, attrs, prefix)
            ignored = self._undefined(name)
        self._push(raw, self._alias(name), ignored)

    def end(self, tag: str, prefix: str | None = None) -> None:
        name = self._name(tag, prefix)
        if self.is_html:
            self._html_bump(name)
        else:
            self.bump = True
        self._pop(tag)

    def text(self, data: str) -> None:
        if self.hidden or self.ignored or not data:
            return
        if self.bump:
            self.meta_text += GAP if self.meta_text else ""
            self.prop_text += GAP if self.prop_text else ""
        self.meta_text += data
        self.prop_text += data
        self.bump = False

    def comment(self, data: str) -> None:
        data = data.strip(_TRIM)
        if not data:
            return
        m = _COMMAND.fullmatch(data)
        if m and m[2]:
            self.hidden = self.hidden + 1 if m[2].lower() == "noindex" else max(0, self.hidden - 1)
        elif not re.match(r"\w*command\b", data, re.IGNORECASE):
            self.bump = True

    def finish(self) -> Analysis:
        while self.dom:
            self._pop(self.dom[-1].raw)
        self._flush(self.config.default_meta, self.config.default_meta)
        return self.out

    # ---- names and policies

    def _name(self, tag: str, prefix: str | None) -> str:
        name = tag.lower()
        return f"{prefix.lower()}:{name}" if prefix and not self.config.flag("ignore_namespaces") else name

    def _alias(self, name: str) -> str:
        aliases = self.config.tag_aliases
        return aliases.get(name) or aliases.get(self._dotted(name)) or name

    def _html_bump(self, name: str) -> None:
        if name in ("br", "img"):
            self.bump = True
        elif name in KNOWN:
            self.bump = name not in INLINE

    def _html_meta(self, attrs: list[tuple[str, str]], prefix: str | None) -> bool:
        """A <meta name content> pair is a field; True if it was one."""
        found = dict(attrs)
        name, content = found.get("name"), found.get("content")
        if not name:
            return False
        if content is None:
            self.out.warnings.append(f"no content for meta tag {name}")
            return False
        name = name.lower()
        ignored = name not in self.metas and name not in self.config.tag_aliases and self._policy(name, f"HTML meta tag {name}")
        was, self.bump = self.bump, True
        self._push(name, self._alias(name), ignored)
        self.text(content)
        self._pop(name)
        self.bump = was
        return True

    def _policy(self, name: str, what: str) -> bool:
        """Apply the policy for undefined tags; True if their content is ignored."""
        policy = self.config.flag("undefined_tags")
        if policy == "error":
            raise MarkupError(f"{what} is not a defined metaname")
        if policy in ("auto", "autoall"):
            self._define(name, policy == "autoall")
        return policy == "ignore"

    def _define(self, name: str, as_property: bool) -> None:
        self.metas.add(name)
        self.out.new_metas.append(name)
        if as_property and name not in self.properties:
            self.properties.add(name)
            self.out.new_properties.append(name)

    def _undefined(self, name: str) -> bool:
        if name in self.metas or name in self.config.tag_aliases:
            return False
        return self._policy(name, f"XML tag {name}")

    def _attributes(self, name: str, attrs: list[tuple[str, str]], prefix: str | None) -> str:
        policy = self.config.flag("undefined_attributes")
        for key, value in attrs:
            key, value = key.lower(), value.lower()
            if key in self.class_attributes:
                name = f"{name}.{value}"
            own = f"{name}.{key}"
            if own not in self.metas:
                if policy == "error":
                    raise MarkupError(f"XML attribute {own} is not a defined metaname")
                if policy in ("auto", "autoall"):
                    self._define(own, policy == "autoall")
                elif policy == "index":
                    self.bump = True
                    self.text(value)
                    self.bump = True
            if own in self.metas:
                self.bump = True
                self._push(own, own, False)
                self.text(value)
                self._pop(own)
                self.bump = True
        return name

    # ---- stacks and buffers

    def _dotted(self, name: str) -> str | None:
        """The names of all open elements and this one; none where that is longer than any configured name can be."""
        if not self.dom:
            return name
        above = self.dom[-1].path
        return f"{above}.{name}" if above is not None and len(above) + len(name) < self.longest else None

    def _push(self, raw: str, name: str, ignored: bool) -> None:
        dotted = self._dotted(name)
        self.dom.append(_Open(raw, name, dotted, ignored))
        self.raws[raw] += 1
        self.ignored += ignored
        as_property = dotted if dotted in self.properties else name if name in self.properties else None
        if as_property:
            self._store(None)
            self.props.append(_Open(raw, as_property, dotted))
        as_field = name if name in self.metas else dotted if dotted in self.metas else None
        if as_field:
            self._flush(self.fields[-1].name, self.fields[-1].path)
            self.fields.append(_Open(raw, as_field, f"{self.fields[-1].path}/{as_field}"))
        self.dom[-1].is_property, self.dom[-1].is_field = bool(as_property), bool(as_field)

    def _pop(self, raw: str) -> None:
        if not self.raws[raw]:
            return
        while self.dom:
            top = self.dom.pop()
            self.raws[top.raw] -= 1
            self.ignored -= top.ignored
            if top.is_property:
                self._store(self.props.pop().name)
            if top.is_field:
                closed = self.fields.pop()
                self._flush(closed.name, closed.path)
            if top.raw == raw:
                return

    def _store(self, closed: str | None) -> None:
        """The property text goes to the property that closes and to all that are open."""
        if self.prop_text.strip(_TRIM + GAP):
            for name in [*([closed] if closed else []), *(o.name for o in reversed(self.props))]:
                target, own = name, self.config.properties.get(name)
                value, size = self.prop_text, 0
                if own is not None:
                    target = own.alias_for or name
                    own = self.config.properties[target]
                    size = own.max
                if own is None or not own.verbatim:
                    value = re.sub(r"[\x00-\x1f]", " ", value).strip(_TRIM)
                if size:
                    value = value.encode()[:size].decode(errors="ignore")
                self.out.properties.setdefault(target, []).append(value)
        self.prop_text = ""

    def _flush(self, name: str, path: str) -> None:
        """The field text goes to the innermost field; with cascading to the outer ones too."""
        text, self.meta_text = self.meta_text, ""
        if not text:
            return
        own = self.config.metanames.get(name)
        target = own.alias_for if own is not None and own.alias_for else name
        names = [target]
        if self.config.flag("cascade"):
            names += [n for n in dict.fromkeys(o.name for o in reversed(self.fields)) if n != target]
        for n in names:
            if text.strip(_TRIM + GAP):
                self.out.metas.setdefault(n, []).append(text)
            self.out.pieces.append((n, path, text))


class _Html(HTMLParser):
    """Tolerant events: void elements and implied ends are closed."""

    def __init__(self, to: Extractor):
        super().__init__(convert_charrefs=True)
        self.to, self.open, self.raw = to, [], None

    def handle_starttag(self, tag, attrs):
        attrs = [(k, v if v is not None else "") for k, v in attrs]
        while self.open and tag in _CLOSED_BY.get(self.open[-1], ()):
            self.to.end(self.open.pop())
        self.to.start(tag, attrs)
        if tag in VOID:
            if not (tag == "meta" and dict(attrs).get("name")):
                self.to.end(tag)
        else:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            self.to.end(top)
            if top == tag:
                return

    def handle_data(self, data):
        if self.open and self.open[-1] in ("script", "style") and not self.to.config.flag("index_script"):
            return
        self.to.text(data)

    def handle_comment(self, data):
        self.to.comment(data)


class _LooseXml(HTMLParser):
    """Events of XML that is not well-formed; what follows an error is kept."""

    CDATA_CONTENT_ELEMENTS = ()

    def __init__(self, to: Extractor):
        super().__init__(convert_charrefs=True)
        self.to = to

    def set_cdata_mode(self, elem, **kwargs):
        pass

    def handle_starttag(self, tag, attrs):
        self.to.start(tag, [(k, v or "") for k, v in attrs if not k.startswith("xmlns")])

    def handle_endtag(self, tag):
        self.to.end(tag)

    def handle_data(self, data):
        self.to.text(data)

    def handle_comment(self, data):
        self.to.comment(data)


def parse_html(text: str, config: Config, uri: str = "") -> Analysis:
    to = Extractor(config, True, uri)
    reader = _Html(to)
    reader.feed(text)
    reader.close()
    return to.finish()


def parse_xml(content: bytes | str, config: Config, uri: str = "", depth: int = 0, root: str = "", from_files: bool = True) -> Analysis:
    """Strict events, or loose ones from the whole text if it is not well-formed."""
    to = Extractor(config, False, uri, depth, root, from_files)
    reader = expat.ParserCreate(namespace_separator=None)
    scopes: list[dict[str, str]] = [{}]

    def start(name, attrs):
        scope = scopes[-1] | {k[6:] if ":" in k else "": v for k, v in zip(attrs[::2], attrs[1::2], strict=True) if k == "xmlns" or k.startswith("xmlns:")}
        scopes.append(scope)
        prefix, _, local = name.rpartition(":")
        own = [(k.rpartition(":")[2], v) for k, v in zip(attrs[::2], attrs[1::2], strict=True) if not k.startswith("xmlns")]
        if local == "include" and scope.get(prefix) in _XINCLUDE and config.flag("follow_xinclude"):
            _include(to, dict(own))
        to.start(local, own, prefix or None)

    def end(name):
        scopes.pop()
        prefix, _, local = name.rpartition(":")
        to.end(local, prefix or None)

    reader.ordered_attributes = True
    reader.buffer_text = True
    reader.StartElementHandler, reader.EndElementHandler = start, end
    reader.CharacterDataHandler, reader.CommentHandler = to.text, to.comment
    # an entity that is not declared must not expand
    reader.EntityDeclHandler = lambda *a: None
    try:
        reader.Parse(content.encode() if isinstance(content, str) else content, True)
    except expat.ExpatError as e:
        to = Extractor(config, False, uri, depth, root, from_files)
        loose = _LooseXml(to)
        loose.feed(content if isinstance(content, str) else content.decode("utf-8", "replace"))
        loose.close()
        to.out.warnings.append(f"not well-formed: {e}")
    return to.finish()


def resolved(uri: str, href: str) -> str:
    """Where a reference leads from a document, in the spelling of the corpus's uris."""
    scheme, mark, rest = uri.rpartition("://")
    if "://" in href:
        return href
    return scheme + mark + posixpath.normpath(posixpath.join(posixpath.dirname(rest), href))


def _include(to: Extractor, attrs: dict[str, str]) -> None:
    """Take in another local file: its fields, properties and pieces follow what is here so far.

    Only files in the document's own folder or below it are read, wherever links lead.
    Documents that are not files are only noted.
    """
    href = attrs.get("href")
    if not href:
        return
    if not to.from_files:
        to.out.includes.append((resolved(to.uri, href), "T" if attrs.get("parse") == "text" else "X"))
        return
    path = href if os.path.isabs(href) else os.path.join(os.path.dirname(to.uri), href)
    try:
        if to.depth >= MAX_INCLUDE_DEPTH:
            raise OSError("included too deeply")
        own = os.path.realpath(os.path.dirname(to.root or to.uri) or ".")
        if os.path.commonpath([own, os.path.realpath(path)]) != own:
            raise OSError("outside the document's folder")
        with open(path, "rb") as f:
            content = f.read()
    except OSError as e:
        to.out.warnings.append(f"cannot include {href}: {e}")
        return
    if attrs.get("parse") == "text":
        got = parse_text(content.decode("utf-8", "replace"), to.config, path)
    else:
        got = parse_xml(content, to.config, path, to.depth + 1, to.root or to.uri)
    for mine, theirs in ((to.out.properties, got.properties), (to.out.metas, got.metas)):
        for k, v in theirs.items():
            mine.setdefault(k, []).extend(v)
    to.out.pieces += got.pieces
    to.out.warnings += got.warnings


def parse_text(text: str, config: Config, uri: str = "") -> Analysis:
    """Plain text: all of it in the default field, the document's name in the title field, no properties."""
    out = Analysis()
    for meta, value in ((config.default_meta, text), (config.title_meta, uri)):
        if value.strip(_TRIM):
            out.metas[meta] = [value]
        out.pieces.append((meta, meta, value))
    return out


def decode(content: bytes, parser: str, encoding: str | None = None) -> tuple[str | bytes, str]:
    """Text of a document and its encoding.

    UTF-8 where it is valid, else the given encoding; HTML and text fall back
    to Latin-1, XML is read by its prolog.
    """
    try:
        return content.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError:
        pass
    kind = parser[:1].upper()
    if kind == "X":
        m = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([\w.-]+)", content)
        return content, m[1].decode() if m else "UTF-8"
    if kind == "H":
        m = re.search(rb"<meta[^>]*charset=[\"']?([\w.-]+)", content[:4096], re.IGNORECASE)
        encoding = encoding or (m[1].decode() if m else None)
    try:
        return content.decode(encoding or "latin-1"), encoding or "ISO-8859-1"
    except (LookupError, UnicodeDecodeError):
        return content.decode("latin-1"), "ISO-8859-1"


def analyze(content: bytes | str | None, parser: str, config: Config, uri: str = "", encoding: str | None = None, from_files: bool = True) -> Analysis:
    """Dispatch by the first letter of the parser's name; an empty document gives a warning and nothing else.

    What a document includes is read from files, or only noted.
    """
    kind = parser[:1].upper()
    if kind not in ("H", "X", "T"):
        raise MarkupError(f"unknown parser: {parser}")
    if not content:
        return Analysis(warnings=["empty document"])
    found = "UTF-8"
    if isinstance(content, bytes):
        content, found = decode(content, parser, encoding)
    if isinstance(content, str) and "\x00" in content:
        content = content.replace("\x00", "\n").replace(GAP, "\n")
    if kind == "H":
        out = parse_html(content, config, uri)
    elif kind == "X":
        out = parse_xml(content, config, uri, from_files=from_files)
    else:
        out = parse_text(content, config, uri)
    out.encoding = found
    return out
