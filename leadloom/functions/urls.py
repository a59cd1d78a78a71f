"""URLs taken apart as the URL standard has it: scheme, host, path and parameters, each by its own rules."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote, quote_plus, unquote_plus, unquote_to_bytes

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Schemes with a host, and their ports. Fixed values.
PORTS = {"ftp": 21, "http": 80, "https": 443, "ws": 80, "wss": 443}
_PAIR = StructType([StructField(name, StringType()) for name in ("name", "value", "pair")])
PARTS = StructType([StructField("base", StringType()), StructField("query", ArrayType(_PAIR))])
#: Characters that a path keeps as they are, beside letters and digits.
PATH = "!$%&'()*+,-./:;=@[\\]^_|~"
FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


def _number(text: str) -> int | None:
    """A number of an IPv4 address: decimal, 0x hexadecimal or 0 octal; None if it is none."""
    for pattern, base, skip in ((r"0[xX][0-9a-fA-F]*", 16, 2), (r"0[0-7]+", 8, 1), (r"0|[1-9][0-9]*", 10, 0)):
        if re.fullmatch(pattern, text):
            return int(text[skip:] or "0", base)
    return None


def _ipv4(host: str) -> str | None:
    """The dotted form of a host that ends in a number; the host itself otherwise; None if it is a wrong address."""
    parts = host.split(".")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    if not parts or not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return host
    numbers = [_number(p) for p in parts]
    if len(numbers) > 4 or any(n is None for n in numbers) or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _ipv6(text: str) -> str | None:
    """Shortest form: hexadecimal groups, the first longest run of zeros as ::."""
    try:
        groups = [f"{int.from_bytes(ipaddress.IPv6Address(text).packed[i : i + 2]):x}" for i in range(0, 16, 2)]
    except ValueError:
        return None
    runs = max(re.finditer(r"(?:(?<=:)|^)0(?::0)+(?=:|$)", ":".join(groups)), key=lambda m: m.end() - m.start(), default=None)
    joined = ":".join(groups)
    return f"[{joined}]" if runs is None else f"[{joined[: runs.start()].rstrip(':')}::{joined[runs.end() :].lstrip(':')}]"


def _label(label: str) -> str | None:
    """A label of a host in ASCII."""
    if label.isascii():
        return label
    coded = label.encode("punycode").decode()
    return None if any(unicodedata.category(c) in ("Cn", "Cs", "Co") for c in label) else f"xn--{coded}"


def url_host(text: str) -> str | None:
    """A host in its canonical form; None if it is none."""
    if text.startswith("["):
        return _ipv6(text[1:-1]) if text.endswith("]") and "%" not in text else None
    try:
        text = unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        return None
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower().replace("­", "")).replace("。", ".")
    labels = [_label(x) for x in text.split(".")]
    host = None if None in labels else ".".join(labels)
    return _ipv4(host) if host and not FORBIDDEN.search(host) else None


def url_path(text: str) -> str:
    """A path without dot segments, escaped, with single slashes and none at its end."""
    out: list[str] = []
    names = text.split("/")[1:]
    for i, name in enumerate(names):
        dots = re.sub("%2e", ".", name, flags=re.I)
        last = i == len(names) - 1
        if dots == "..":
            del out[-1:]
        elif dots != ".":
            out.append(quote(name, safe=PATH))
            continue
        if last:
            out.append("")
    return "/" + "/".join(x for x in out if x)


def parameters(query: str) -> list[tuple[str, str, str]]:
    """(name, value, name and value as a form has them) of a query."""
    out = []
    for part in filter(None, query.split("&")):
        name, _, value = part.partition("=")
        name, value = unquote_plus(name, errors="replace"), unquote_plus(value, errors="replace")
        plain = lambda x: quote_plus(x, safe="*-._").replace("~", "%7E")
        out.append((name, value, f"{plain(name)}={plain(value)}"))
    return out


def take_apart(value: str) -> tuple[str, list[tuple[str, str, str]]] | None:
    """(everything before the query, parameters) of an absolute URL; None if it is none."""
    text = re.sub("[\t\n\r]", "", value.strip("".join(map(chr, range(33)))))
    scheme, colon, rest = text.partition(":")
    scheme = scheme.lower()
    if not colon or not re.fullmatch(r"[a-z][a-z0-9+.-]*", scheme):
        return None
    rest, _, query = rest.partition("#")[0].partition("?")
    if scheme in PORTS:
        rest = rest.replace("\\", "/").lstrip("/")
    elif rest.startswith("//"):
        rest = rest[2:]
    else:  # no host: such paths are not resolved
        return f"{scheme}:{quote(rest, safe=PATH + '`{}<>#\"^ ')}", parameters(query)
    authority, slash, path = rest.partition("/")
    authority = authority.rpartition("@")[2]
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", authority)
    host = url_host(found[1]) if found and found[1] else None
    port = int(found[2]) if found and found[2] else None
    if host is None or (port is not None and port > 65535):
        return None
    end = "" if port in (None, PORTS.get(scheme)) else f":{port}"
    return f"{scheme}://{host}{end}{url_path(slash + path) if slash or scheme in PORTS else ''}", parameters(query)


@F.pandas_udf(PARTS)
def url_parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for urls in batches:
        rows = [(None, []) if url is None or (found := take_apart(url)) is None else found for url in urls]
        yield pd.DataFrame({"base": [r[0] for r in rows], "query": [[{"name": a, "value": b, "pair": c} for a, b, c in r[1]] for r in rows]})
