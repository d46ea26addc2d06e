"""Markup residue: which kinds a text holds, and the clean text a reader would see.

One parse gives both. A ``Page`` builds the HTML tree (implied end tags, invisible elements, preformatted text), lays its
blocks, lists and table cells out as text, and turns Markdown, wiki and LaTeX constructs into the text they show; every
construct that it meets names its kind (html, markdown, wiki, latex). Headings, list items, code blocks and formulas stay
recognisable. What stands in a fenced block counts as markdown only; what a construct has shown is kept aside, so that
its signs are not read again as markup.

Null gives null and no kinds; an empty text gives an empty text. Repeated rows give equal results. Extra columns are
left alone. Every rule is linear in the length of a line, but for commands nested in commands, which take a round each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.plans.runtime import spread

# fixed values: HTML element names
ELEMENTS = set(
    "a abbr address article aside audio b bdi bdo big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em "
    "embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav "
    "noscript object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style template noscript title iframe object svg canvas".split())
BLOCK = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
# an opening tag closes these open elements first
HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())  # what stands in head; all else ends it
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
IMPLIED = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "option": {"option"},
    **{b: {"p"} for b in ("p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hr", "section", "article", "form")},
}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}}
WIKI_TAGS = {"nowiki", "ref", "references", "gallery", "noinclude", "includeonly"}
# fixed values: LaTeX commands that stand without braces
TEX_WORDS = set(
    "item sum int prod frac sqrt log ln exp sin cos tan lim max min leq geq le ge neq ne approx equiv times cdot cdots ldots dots infty partial nabla alpha beta gamma delta epsilon zeta "
    "eta theta kappa lambda mu nu xi pi rho sigma tau phi chi psi omega Gamma Delta Theta Lambda Sigma Phi Psi Omega in notin subset cup cap forall exists to rightarrow leftarrow Rightarrow "
    "quad qquad hline maketitle tableofcontents noindent newline newpage centering par bf it tt em small large left right begin end section label mathbb".split()
)

FENCE = re.compile(r"^[ ]{0,3}(```+|~~~+)[^\n`]*$")
TAG = re.compile(r"<!--.*?(?:-->|$)|<!DOCTYPE[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z_:@-][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*)\s*(/?)>", re.S)
ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
CODE = re.compile(r"(?<![`\\])(`{1,3})(?!`)([^\n]+?)(?<!`)\1(?!`)")

MD_BLOCK = re.compile(
    r"^(?:[ ]{0,3}#{1,6}[ \t]+\S.*|[ \t]*[-*+][ \t]+\S.*|[ \t]*\d{1,9}[.)][ \t]+\S.*|[ ]{0,3}>[ \t]?\S.*|[ ]{0,3}(?:-[ ]?){3,}[ \t]*|[ ]{0,3}(?:\*[ ]?){3,}[ \t]*|[ ]{0,3}(?:_[ ]?){3,}[ \t]*"
    r"|[ ]{0,3}\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{2,}:?[ ]*)+\|?[ \t]*|[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S.*)$", re.M)
MD_SETEXT = re.compile(r"^(?=[^\n]*\w)[^\n=|{<>#-][^\n]*\n(?:={3,}|-{3,})[ \t]*$", re.M)
MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*(?:\([^()\s]*\))?[^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
MD_REF = re.compile(r"!?\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]|\[\^([\w-]+)\]")
MD_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>")
MD_BOLD = re.compile(r"(?<![\w*\\])\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*(?!\*)|(?<![\w_\\])__(?=\S)([^_\n]*\s[^_\n]*?)(?<=\S)__(?![\w_])")
MD_EM = re.compile(r"(?<![\w*\\/.])\*(?![\s*])([^*\n]+?)(?<![\s*\\])\*(?![\w*])|(?<![\w_\\/.])_(?![\s_])([^_\n]+?)(?<![\s_\\])_(?![\w_(])")
MD_STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~")

WIKI_BLOCK = re.compile(r"^(?:(={2,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*|\{\|.*|\|-+[ \t]*(?:[a-z]+=[^|\n]*)?|\|\}[ \t]*|#REDIRECT\b.*|__[A-Z]{3,}__[ \t]*)$", re.M)
WIKI_LINK = re.compile(r"\[\[([^\W\d_][^\[\]\n|]*|:[^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_CALL = re.compile(r"\{\{\s*[#:]?[^\W\d_][^{}]*\}\}")
WIKI_QUOTE = re.compile(r"(?<!')('''''|'''|'')(?!')(?=\S)([^'\n]+(?:'(?!')[^'\n]+)*)(?<=\S)\1(?!')")
WIKI_URL = re.compile(r"(?<![\[!\w])\[(?:https?|ftp)://[^\s\[\]]+(?:\s+([^\[\]\n]+))?\](?!\()")

TEX_ENV = re.compile(r"\\(?:begin|end)\s*\{[a-zA-Z*]+\}")
TEX_CALL = re.compile(r"(?<![\\\w:])\\([a-zA-Z]+)\*?(?:\[[^\]\n]*\])?\{")
TEX_BARE = re.compile(r"(?<![\\\w:])\\([a-zA-Z]+)(?![a-zA-Z\\{])")
TEX_DISPLAY = re.compile(r"\$\$(?=\S)([^$]+?)(?<=\S)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
TEX_INLINE = re.compile(r"(?<![\w$\\])\$(?![\s$])([^$\n]+?)(?<![\s\\])\$(?![\w$])")
MATH = re.compile(r"[\\^_{}=+*/<>()-]|^\w$|^[a-zA-Z]\w?$")


def _math(body: str) -> bool:
    return bool(MATH.search(body)) and not re.fullmatch(r"[\d.,\s]*(?:\w+\s+)*", body)


def _tag(m: re.Match) -> str | None:
    """Kind of a matched tag, or None if it is no markup."""
    name = m.group(2)
    if name is None:
        return "html"
    low = name.lower()
    return "html" if low in ELEMENTS else "wiki" if low in WIKI_TAGS else None


def _entity(m: re.Match) -> bool:
    name = m.group(1)
    return name[0] == "#" or name + ";" in html.entities.html5


def segments(text: str) -> list[tuple[bool, str]]:
    """(fenced, text) parts in order; an unclosed fence runs to the end."""
    if "```" not in text and "~~~" not in text:
        return [(False, text)]
    parts: list[tuple[bool, list[str]]] = [(False, [])]
    mark = ""
    for line in text.split("\n"):
        m = FENCE.match(line.rstrip("\r"))
        if mark:
            parts[-1][1].append(line)
            if m and line.strip() == m.group(1) and m.group(1)[0] == mark[0] and len(m.group(1)) >= len(mark):
                mark = ""
                parts.append((False, []))
        elif m:
            mark = m.group(1)
            parts.append((True, [line]))
        else:
            parts[-1][1].append(line)
    return [(f, "\n".join(p)) for f, p in parts if p]


def _hides(attrs: str) -> bool:
    """Whether the attribute hidden or a declaration of the style hides the element."""
    seen = {}
    for name, *values in ATTR.findall(attrs):
        seen.setdefault(name.lower(), "".join(values))
    return "hidden" in seen and seen["hidden"].strip().lower() != "until-found" or bool(UNSEEN.search(html.unescape(seen.get("style", ""))))


class _Layout:
    """Tree builder and renderer in one pass: the open elements are a stack, tables collect their rows until they close."""

    def __init__(self, keep) -> None:
        self.keep = keep  # puts text aside that is markup no more
        self.out: list[str] = []
        self.stack: list[str] = []
        self.lists: list[list] = []
        self.tables: list[list[list[list[str]]]] = []
        self.loose: list[list[str]] = []  # text of each open table that is in no cell
        self.cells: list[bool] = []  # whether a cell of each open table is open
        self.hidden: list[bool] = []

    def emit(self, s: str) -> None:
        if any(self.hidden):
            return
        if not self.tables:
            self.out.append(s)
        elif self.cells[-1]:
            self.tables[-1][-1][-1].append(s)
        else:
            self.loose[-1].append(s)

    def text(self, s: str) -> None:
        s = ENTITY.sub(lambda m: self.entity(m) if _entity(m) else m.group(0), s)
        if self.stack[-1:] == ["head"] and s.strip():
            self.close("head")
        self.emit(s.replace("\xa0", " "))

    def entity(self, m: re.Match) -> str:
        c = html.unescape(m.group(0))
        return c if c.isalnum() or c.isspace() else self.keep(c)

    def line(self) -> None:
        self.emit("\n")

    def close(self, name: str) -> None:
        if name not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            self.hidden.pop()
            if top in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.line()
            elif top == "table" and self.tables:
                rows = [["".join(c).strip().replace("\n", " ") for c in row] for row in self.tables.pop()]
                self.cells.pop()
                loose = "\n".join(x.strip() for x in "".join(self.loose.pop()).split("\n") if x.strip())
                self.emit("\n" + (loose + "\n" if loose else "") + align(rows) + "\n")
            elif top in ("td", "th") and self.tables:
                self.cells[-1] = False
            elif top == "pre":
                self.emit("\n```\n")
            elif top in BLOCK:
                self.line()
                if top in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "details", "div"):
                    self.line()
            elif top == "q":
                self.emit('"')
            if top == name:
                break

    def open(self, name: str, attrs: str, closed: bool) -> None:
        if self.stack[-1:] == ["head"] and name not in HEAD:  # its end may be left out
            self.close("head")
        stop = SCOPE.get(name, set())
        while self.stack and self.stack[-1] in IMPLIED.get(name, ()) and self.stack[-1] not in stop:
            self.close(self.stack[-1])
        if name == "br":
            return self.line()
        if name == "hr":
            return self.emit("\n" + self.keep("---") + "\n")
        if name == "img":
            m = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attrs, re.I)
            return self.emit(m.group(1) or m.group(2) or "") if m else None
        if name in VOID or closed:
            return None
        self.stack.append(name)
        self.hidden.append(name in HIDDEN or _hides(attrs))
        if name in ("ul", "ol"):
            self.lists.append([name, 0])
            self.line()
        elif name == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. "
            self.emit("\n" + self.keep("  " * depth + mark))
        elif name == "table":
            self.tables.append([])
            self.loose.append([])
            self.cells.append(False)
        elif name == "tr" and self.tables:
            self.tables[-1].append([])
        elif name in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append([])
            self.cells[-1] = True
        elif name == "pre":
            self.emit("\n```\n")
        elif name in BLOCK:
            self.line()
        elif name == "q":
            self.emit('"')
        return None


def align(rows: list[list[str]]) -> str:
    """Cells in columns as wide as their widest cell."""
    rows = [r for r in rows if r]
    width = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
    return "\n".join("  ".join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in rows)


def _tex_text(s: str, keep=str) -> str:
    """Commands to what they show; formulas keep their source without the delimiters."""
    s = re.sub(r"\\(?:begin|end)\s*\{(?:itemize|enumerate|description|document|quote|center|equation\*?|align\*?|abstract|verbatim|figure|table)\}(?:\[[^\]\n]*\])?", "", s)
    s = re.sub(r"^[ \t]*\\item\b[ \t]*(?:\[([^\]\n]*)\])?", lambda m: keep("- ") + (m.group(1) + " " if m.group(1) else ""), s, flags=re.M)
    while True:  # nested commands, from the inside; each round takes braces away
        t = re.sub(r"\\(?:part|chapter|(?:sub)*section|paragraph|title)\*?\{([^{}]*)\}", r"\1", s)
        t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
        t = re.sub(r"\\(?:cite[tp]?|ref|eqref|pageref)\{([^{}]*)\}", r"[\1]", t)
        t = re.sub(r"\\label\{[^{}]*\}", "", t)
        t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
        t = re.sub(r"\\(?:text(?:bf|it|tt|sc|rm|sf)?|emph|underline|mbox|url)\{([^{}]*)\}", r"\1", t)
        if t == s:
            break
        s = t
    return s.replace("~\\", " \\")


def _tables(lines: list[str]) -> list[str]:
    """Markdown and wiki tables as aligned cells."""
    out: list[str] = []
    rows: list[list[str]] = []
    wiki = False

    def flush() -> None:
        if rows:
            out.append(align(rows))
            rows.clear()

    for k, line in enumerate(lines):
        s = line.strip()
        if s.startswith("{|"):
            wiki = True
            flush()
        elif wiki and s.startswith("|}"):
            wiki = False
            flush()
        elif wiki and s.startswith("|-"):
            rows.append([])
        elif wiki and s[:1] in "|!":
            cells = [c.strip() for c in re.split(r"\|\||!!", s[1:])]
            if rows:
                rows[-1] += cells
            else:
                rows.append(cells)
        elif len(s) > 2 and s[0] == "|" and s[-1] == "|":
            if not re.fullmatch(r"[|:\s-]+", s):
                rows.append([c.strip() for c in s[1:-1].split("|")])
        else:
            if not wiki:
                flush()
            out.append(line)
    flush()
    return out


LINE_HEAD = re.compile(r"[ ]{0,3}#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$|={2,6}[ \t]*(.*?)[ \t]*={2,6}[ \t]*$")
LINE_RULE = re.compile(r"[ ]{0,3}(?:={3,}|(?:-[ ]?){3,}|(?:\*[ ]?){3,}|(?:_[ ]?){3,})[ \t]*")
LINE_QUOTE = re.compile(r"^[ ]{0,3}(?:>[ ]?)+")
LINE_ITEM = re.compile(r"^([ \t]*)[*+-][ \t]+(\[[ xX]\][ \t]+)?")


def _blocks(part: str) -> str:
    out: list[str] = []
    for line in _tables(part.split("\n")):
        if line.lstrip()[:1] in ("#", "=", "-", "*", "_", ">", "+"):
            m = LINE_HEAD.match(line)
            if m:
                line = m.group(1) if m.group(1) is not None else m.group(2)
            elif LINE_RULE.fullmatch(line):
                continue
            else:
                line = LINE_ITEM.sub(r"\1- ", LINE_QUOTE.sub("", line))
        out.append(line)
    return "\n".join(out)


KEPT = re.compile("\x00(\\d+)\x00")


class Page:
    """The parse of one text: ``text``, what a reader sees, and ``kinds``, those of the constructs met."""

    def __init__(self, source: str):
        self.kinds: set[str] = set()
        self.kept: list[str] = []
        done = []
        for fenced, part in segments(source.replace("\x00", "\ufffd").replace("\r\n", "\n").replace("\r", "\n")):
            if fenced:
                self.kinds.add("markdown")
            done.append(part if fenced else self.part(part))
        clean = "\n".join(x.rstrip() for x in "\n".join(done).split("\n"))
        self.text = re.sub(r"\n{3,}", "\n\n", clean).strip()

    def keep(self, s: str) -> str:
        self.kept.append(s)
        return f"\x00{len(self.kept) - 1}\x00"

    def shown(self, s: str) -> str:
        """With everything kept aside put back."""
        while "\x00" in s:
            s = KEPT.sub(lambda m: self.kept[int(m.group(1))], s)
        return s

    def met(self, kind: str, s: str) -> str:
        self.kinds.add(kind)
        return s

    def sub(self, pattern: re.Pattern, kind: str, show, s: str) -> str:
        return pattern.sub(lambda m: self.met(kind, show(m)), s)

    def part(self, s: str) -> str:
        if "`" in s:
            s = self.sub(CODE, "markdown", lambda m: self.keep(m.group(2)), s)
        if "<" in s:
            s = self.sub(MD_AUTO, "markdown", lambda m: self.keep(m.group(1)), s)
        out = []
        for pre, piece in segments(self.html(s)):
            read = self.marked(piece)
            out.append(piece if pre else read)  # preformatted text is read for its kinds, and shown as it stands
        return self.shown("\n".join(out))

    def html(self, s: str) -> str:
        """The layout of the element tree."""
        if "<" not in s and "&" not in s:
            return s
        if "&" in s and any(_entity(m) for m in ENTITY.finditer(s)):
            self.kinds.add("html")
        lay, at = _Layout(self.keep), 0
        for m in TAG.finditer(s):
            kind = _tag(m)
            if kind is None:
                continue
            self.kinds.add(kind)
            lay.text(s[at : m.start()])
            at = m.end()
            if m.group(2) and kind != "wiki":
                name = m.group(2).lower()
                if m.group(1):
                    lay.close(name)
                else:
                    lay.open(name, m.group(3) or "", bool(m.group(4)))
        lay.text(s[at:])
        while lay.stack:
            lay.close(lay.stack[-1])
        return "".join(lay.out)

    def marked(self, s: str) -> str:
        """LaTeX, wiki and Markdown constructs, in this order: the signs of formulas are no Markdown."""
        if "\\" in s or "$" in s:
            s = self.sub(TEX_DISPLAY, "latex", lambda m: self.keep(next(g for g in m.groups() if g is not None).strip()), s)
            s = TEX_INLINE.sub(lambda m: self.met("latex", self.keep(m.group(1))) if _math(m.group(1)) else m.group(0), s)
            if TEX_ENV.search(s) or TEX_CALL.search(s) or any(m.group(1) in TEX_WORDS for m in TEX_BARE.finditer(s)):
                self.kinds.add("latex")
                s = _tex_text(s, self.keep)
        if "{{" in s:
            s = self.sub(WIKI_CALL, "wiki", lambda m: m.group(0).strip("{} ").rpartition("|")[2], s)
        links = "[" in s
        if links:
            s = self.sub(WIKI_LINK, "wiki", lambda m: m.group(2) or m.group(1).partition("Category:")[2] or m.group(1), s)
            s = self.sub(WIKI_URL, "wiki", lambda m: m.group(1) or "", s)
        if "''" in s:
            s = self.sub(WIKI_QUOTE, "wiki", lambda m: m.group(2), s)
        if WIKI_BLOCK.search(s):
            self.kinds.add("wiki")
            rest = WIKI_BLOCK.sub(" ", s)
        else:
            rest = s
        if MD_BLOCK.search(rest) or MD_SETEXT.search(rest):
            self.kinds.add("markdown")
        s = _blocks(s)
        if links:
            s = self.sub(MD_LINK, "markdown", lambda m: m.group(1), s)
            s = self.sub(MD_REF, "markdown", lambda m: m.group(1) or "", s)
        if "*" in s or "_" in s:
            s = self.sub(MD_BOLD, "markdown", lambda m: m.group(1) or m.group(2), s)
            s = self.sub(MD_EM, "markdown", lambda m: m.group(1) or m.group(2), s)
        return self.sub(MD_STRIKE, "markdown", lambda m: m.group(1), s) if "~~" in s else s


def kinds(text: str | None) -> set[str]:
    return Page(text).kinds if text else set()


def all_kinds(text: str | None, heading_path: str | None) -> set[str]:
    found = kinds(text)
    for part in (heading_path or "").split(" > "):
        found = found | kinds(part)
    return found


def render(text: str | None) -> str | None:
    return None if text is None else Page(text).text


def render_path(path: str | None) -> str | None:
    return None if path is None else " > ".join(render(p) or "" for p in path.split(" > "))


def markup_kinds(chunks: DataFrame) -> DataFrame:
    """chunk_key, markup: each kind once per key, over all rows of the key."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, texts, paths = (batch.column(k).to_pylist() for k in range(3))
            rows = [(k, m) for k, t, p in zip(keys, texts, paths) for m in sorted(all_kinds(t, p))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["chunk_key", "markup"])

    return spread(chunks.select("chunk_key", "text", "heading_path")).mapInArrow(run, "chunk_key string, markup string").distinct()


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_key, heading_path, text: the clean text of each key's newest row (ties: the greater text)."""
    newest = chunks.groupBy("chunk_key").agg(F.max_by(F.struct("heading_path", "text"), F.struct("arrived_at", "text")).alias("r")).select("chunk_key", "r.heading_path", "r.text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            paths = [render_path(p) for p in batch.column(1).to_pylist()]
            texts = [render(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["chunk_key", "heading_path", "text"])

    return newest.mapInArrow(run, "chunk_key string, heading_path string, text string")
