"""URL checks and normal forms for relays, media servers and proxies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from whisperlake.functions.text import as_col, trimmed

# Groups: scheme, user info with @, host, port, path, query with ?, fragment with #.
URL_PATTERN = (
    r"\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@\s]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]\s]+)"
    r"(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(#.*)?\z"
)
_SCHEME, _USER, _HOST, _PORT, _PATH, _QUERY, _FRAGMENT = range(1, 8)

# Default ports and the schemes each setting accepts.
DEFAULT_PORTS = {"ws": "80", "wss": "443", "http": "80", "https": "443"}
RELAY_SCHEMES = ("ws", "wss")
WEB_SCHEMES = ("http", "https")
PROXY_SCHEMES = ("socks5", "socks5h", "socks4", "socks4a", "http", "https")


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, URL_PATTERN, group)


def url_scheme(c: str | Column) -> Column:
    return F.lower(_part(trimmed(c), _SCHEME))


def url_host(c: str | Column) -> Column:
    return F.lower(_part(trimmed(c), _HOST))


def is_absolute_url(c: str | Column, schemes: tuple[str, ...]) -> Column:
    c = trimmed(c)
    port = _part(c, _PORT)
    port_ok = (port == "") | (F.coalesce(port.try_cast("int"), F.lit(65_536)) <= 65_535)
    return F.coalesce(F.lower(_part(c, _SCHEME)).isin(*schemes) & port_ok, F.lit(False))


def relay_url_valid(c: str | Column, schemes: tuple[str, ...] = RELAY_SCHEMES) -> Column:
    return is_absolute_url(c, schemes)


def _explicit_port(c: Column) -> Column:
    """``:port`` unless it is missing or the scheme's default."""
    port = _part(c, _PORT).try_cast("int").cast("string")
    ports = F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair])
    default = F.try_element_at(ports, F.lower(_part(c, _SCHEME)))
    return F.when(port.isNull() | port.eqNullSafe(default), F.lit("")).otherwise(F.concat(F.lit(":"), port))


def normalize_relay_url(c: str | Column) -> Column:
    """Lower-case scheme and host, no default port, no slash at the end of the path, no fragment."""
    c = trimmed(c)
    return F.concat(
        F.lower(_part(c, _SCHEME)), F.lit("://"), F.lower(_part(c, _HOST)), _explicit_port(c),
        F.rtrim(_part(c, _PATH), F.lit("/")), _part(c, _QUERY),
    )


def canonical_web_url(c: str | Column) -> Column:
    """The URL as a browser would print it: case of scheme and host folded, path at least ``/``."""
    c = trimmed(c)
    path = _part(c, _PATH)
    return F.concat(
        F.lower(_part(c, _SCHEME)), F.lit("://"), _part(c, _USER), F.lower(_part(c, _HOST)), _explicit_port(c),
        F.when(path == "", F.lit("/")).otherwise(path), _part(c, _QUERY), _part(c, _FRAGMENT),
    )


def is_onion(c: str | Column) -> Column:
    return F.coalesce(url_host(c).endswith(".onion"), F.lit(False))


def with_default_scheme(c: str | Column, scheme: str) -> Column:
    """Bare input such as ``relay.example.com`` gets a scheme in front."""
    c = trimmed(c)
    return F.when(c.contains("://"), c).otherwise(F.concat(F.lit(f"{scheme}://"), c))


def relay_url_list(urls: str | Column, schemes: tuple[str, ...] = RELAY_SCHEMES) -> Column:
    """Valid entries in normal form, distinct, order kept."""
    valid = F.filter(as_col(urls), lambda u: relay_url_valid(u, schemes))
    return F.array_distinct(F.transform(valid, normalize_relay_url))


def media_server_list(urls: str | Column) -> Column:
    """Trimmed http(s) servers without a slash at the end, distinct, order kept."""
    bare = F.transform(as_col(urls), lambda u: F.rtrim(trimmed(u), F.lit("/")))
    return F.array_distinct(F.filter(bare, lambda u: is_absolute_url(u, WEB_SCHEMES)))


def require_servers(servers: Column) -> Column:
    """Fails the job when a settings list would end up empty."""
    return F.when(F.size(servers) > 0, servers).otherwise(
        F.raise_error(F.lit("at least one media server is required")).cast("array<string>")
    )


def proxy_url_valid(c: str | Column) -> Column:
    """One of six schemes, a host, and a port (given, or the default of http and https)."""
    c = trimmed(c)
    port = _part(c, _PORT).try_cast("int")
    has_port = F.when(port.isNotNull(), port > 0).otherwise(F.lower(_part(c, _SCHEME)).isin(*WEB_SCHEMES))
    return F.coalesce(is_absolute_url(c, PROXY_SCHEMES) & has_port, F.lit(False))
