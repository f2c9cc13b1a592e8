"""HTML as data in Spark: pages become node tables, and selectors, texts, attributes and HTML are plans over them."""

from importlib import import_module

#: Names of the package and the modules that have them; modules are imported when they are first asked for.
_HOMES = {
    "functions.encoding": ("decode", "sniff_encoding"), "functions.entities": ("lookup", "unescape"), "functions.sql": ("register",),
    "operators.extract": ("attribute", "children", "get_attr", "text"), "operators.parse": ("parse_html", "tokenize_html"),
    "operators.query": ("query", "query_one", "reroot"), "operators.serialize": ("to_html",), "sources.pages": ("read_html_bytes", "read_html_files", "read_pages", "save_nodes", "write_nodes"),
    "streaming.pages": ("stream_nodes", "stream_query"),
}
__all__ = sorted(n for names in _HOMES.values() for n in names)


def __getattr__(name: str):
    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(f".{home}", __name__), name)
    raise AttributeError(name)
