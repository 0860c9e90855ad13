"""A forgiving HTML reader: elements in document order, and the text blocks between them.

Start tags imply the end tags that pages leave out (p, li, table cells, options); end tags
close up to their element or are ignored; pages may stop anywhere. Inline elements join the
text around them, every other element bounds a block, and <br> is white space.

Reading takes time in proportion to the page, whatever it holds: no character is looked at more
than a few times, and open elements are found by name, not by walking up the stack.
"""

from __future__ import annotations

import re
from html import unescape

# Element names by their role in HTML.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p
pre search section summary table tbody td tfoot th thead tr ul caption""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())      # no markup inside
SILENT = frozenset("""script style textarea title xmp noscript template iframe object svg math canvas audio
video select button head datalist""".split())                   # text inside is never shown as such
CLOSES = {  # a start tag ends an open element of these names, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td"}, {"table"}),
    "body": ({"head"}, set())}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
SOUND = re.compile(r"""(?:[^<>"']|="[^"<>]*"|='[^'<>]*')*+>""")  # stops at any "<", so no text is scanned twice
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
MARK = re.compile(r'\bdata-y="([01])"')


class _Tags:
    """Finds where tags end. A quote opens a value only behind an equals sign. It is taken for
    a slip, and the tag ends at the first ">" behind it, if it never closes or if a tag ends
    and another begins before it closes. Once a tag runs to the end of the page for its quotes,
    the rest of the page is read without regard to quotes."""

    def __init__(self, html: str):
        self.html, self.quotes, self.no_end = html, True, False
        self.gone: set[str] = set()  # quote characters that do not occur any more

    def _next_end(self, at: int) -> int:
        end = -1 if self.no_end else self.html.find(">", at)
        self.no_end |= end < 0
        return end

    def end(self, at: int) -> int:
        """Place of the ">" that ends the tag whose name ends at ``at``; -1 if none does."""
        html, pos = self.html, at
        if (m := SOUND.match(html, at)) is not None:
            return m.end() - 1
        while self.quotes:
            m = STOP.search(html, pos)
            if m is None:
                self.quotes = False
                break
            if m[0] == ">":
                return m.start()
            pos = m.start() + 1
            if html[at:pos - 1].rstrip()[-1:] != "=" if pos - at < 64 else html[pos - 65:pos - 1].rstrip()[-1:] != "=":
                continue
            close = -1 if m[0] in self.gone else html.find(m[0], pos)
            if close < 0:
                self.gone.add(m[0])
                return self._next_end(pos)
            gt = html.find(">", pos, close)
            if 0 <= gt < html.find("<", pos, close):
                return gt
            pos = close + 1
        return self._next_end(at)


class Page:
    """Element arrays in document order (row 0 is the page itself) and text blocks."""

    def __init__(self, html: str, marks: bool = False):
        self.tag: list[str] = ["#page"]
        self.attrs: list[str] = [""]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.last: list[int] = [0]          # last row of the subtree
        self.tags_inside: list[int] = [0]   # inline tags directly inside
        self.mark: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters inside links)
        self._read(html, marks)

    def _read(self, html: str, marks: bool) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; -1: inline
        places: dict[str, list[int]] = {}              # name -> its places in the stack
        blocks = [0]                                   # places of the open blocks
        node, silent, links, linked = 0, 0, 0, 0
        run: list[str] = []
        n = len(html)

        def topmost(names) -> int:
            return max((places[x][-1] for x in names if places.get(x)), default=0)

        def flush() -> None:
            nonlocal linked
            if run:
                text = "".join(run)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((node, text, min(linked, len(text))))
                run.clear()
            linked = 0

        def close(to: int) -> None:
            """Close the open elements from place ``to`` of the stack on."""
            nonlocal node, silent, links
            while len(stack) > to:
                name, row = stack.pop()
                places[name].pop()
                if name in SILENT:
                    silent -= 1
                if name == "a":
                    links -= 1
                if row >= 0:
                    blocks.pop()
                    flush()
                    self.last[row] = len(self.tag) - 1
                    node = self.parent[row]

        def say(to: int) -> None:
            nonlocal linked
            if to > told and not silent:
                run.append(html[told:to])
                if links:
                    linked += to - told

        tags, at, told = _Tags(html), 0, 0  # text up to ``told`` is in the run or silent
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                break
            kind = html[lt + 1:lt + 2]
            if kind and kind in "!?":
                say(lt)
                comment = html.startswith("<!--", lt)
                end = html.find("-->", lt + 4) if comment else html.find(">", lt + 2)
                at = told = n if end < 0 else end + (3 if comment else 1)
                continue
            # a name may hold "<", so none is looked for where no tag can end any more
            m = None if tags.no_end else NAME.match(html, lt + 1 + (kind == "/"))
            end = tags.end(m.end()) if m else -1
            if end < 0:
                # a tag that the page's end cuts off; elsewhere "<" is a character
                if (kind == "/" or kind.isascii() and kind.isalpha()) and html.find("<", lt + 1) < 0:
                    say(lt)
                    at = told = n
                else:
                    at = lt + 1
                continue
            say(lt)
            at = told = end + 1
            name, attrs = m[0].lower(), html[m.end():end]
            if kind == "/":
                if places.get(name):
                    close(places[name][-1])
                continue
            if name == "br":
                if not silent:
                    run.append(" ")
                continue
            if name in BLOCK and name not in ("html", "body", "head") and stack[blocks[-1]][0] == "p":
                close(blocks[-1])  # a block ends an open paragraph
            if name in CLOSES:
                ends, bound = CLOSES[name]
                if (k := topmost(ends)) > topmost(bound):
                    close(k)
            row = -1
            if name in BLOCK:
                flush()
                row = len(self.tag)
                self.tag.append(name)
                self.attrs.append(attrs)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.last.append(row)
                self.tags_inside.append(0)
                found = MARK.search(attrs) if marks else None
                self.mark.append(int(found[1]) if found else -1)
            else:
                self.tags_inside[node] += 1
            if name in VOID or attrs.endswith("/") and row < 0 and name not in RAW:
                continue
            if row >= 0:
                node = row
                blocks.append(len(stack))
            places.setdefault(name, []).append(len(stack))
            stack.append((name, row))
            silent += name in SILENT
            links += name == "a"
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                at = told = end.start() if end else n
        say(n)
        close(1)
        flush()
        self.last[0] = len(self.tag) - 1


def attribute_words(attrs: str) -> frozenset[str]:
    """Lower-case words of class, id, role and itemprop; camelCase and punctuation split."""
    text = " ".join(v.strip("\"'") for v in NAMES.findall(attrs))
    return frozenset(w.lower() for w in re.findall(r"[A-Za-z][a-z]+|[A-Z]+", text))
