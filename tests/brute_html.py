"""A slow page reader for tests, on the standard library's parser."""

from html.parser import HTMLParser

from pagewarden import lexicon as lx


class Node:
    def __init__(self, name, attrs, parent):
        self.name, self.attrs, self.parent, self.items = name, attrs, parent, []

    def strings(self):
        for item in self.items:
            if isinstance(item, Node):
                yield from item.strings() if item.name not in ("script", "style") else ()
            else:
                yield item

    def nodes(self):
        for item in self.items:
            if isinstance(item, Node):
                yield item
                yield from item.nodes()


class Reader(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.stack = [self.root]
        self.every_string = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.stack[-1])
        self.stack[-1].items.append(node)
        if tag not in lx.VOID_TAGS:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.stack[-1])
        self.stack[-1].items.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.every_string.append(data)
        self.stack[-1].items.append(data)

    def handle_comment(self, data):
        self.every_string.append(data)


def has(text, phrases):
    return any(p in text.lower() for p in phrases)


def read(html):
    """(plain text, links, forms, banner) of a page."""
    page = Reader(html)
    nodes = list(page.root.nodes())
    links = [(n.attrs["href"], "".join(n.strings()).strip().lower())
             for n in nodes if n.name == "a" and n.attrs.get("href")]
    forms = []
    for n in nodes:
        if n.name == "form":
            inner = list(n.nodes())
            fields = [i.attrs["name"] for t in ("input", "textarea") for i in inner
                      if i.name == t and i.attrs.get("name")]
            chain, up = [n], n.parent
            while up is not None and len(chain) <= lx.NOTICE_LEVELS:
                chain.append(up)
                up = up.parent
            notice = any(has(" ".join(c.strings()), lx.PRIVACY_NOTICE_PHRASES) for c in chain)
            forms.append((n.attrs.get("action"), (n.attrs.get("method") or "GET").upper(),
                          fields, notice))
    banner = any(has(s, lx.BANNER_PHRASES) for s in page.every_string) or any(
        n.name in lx.BANNER_TAGS and has(n.attrs.get("id", "") + " " + n.attrs.get("class", ""),
                                         lx.BANNER_MARKERS) for n in nodes)
    return " ".join(" ".join(page.root.strings()).split()), links, forms, banner
