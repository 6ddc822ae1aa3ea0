"""Views of agent settings and server configurations in JSON. Places stay; what an agent would not load is empty.

Strings are decoded where they stand and padded, as escapes only make them shorter. A decoded quote becomes a single one
and a line break a space, so that a value can't look like a key.
"""

from __future__ import annotations

import ipaddress
import json
import re
import unicodedata
from urllib.parse import unquote

# fixed values: fields that start a server, files that hold them, and references to the environment in headers
STARTUP_FIELD = re.compile(r"(?:\"(?:command|args)\"\s*:|\b(?:command|args)\s*=)", re.I | re.A)
STARTUP_FILES = (".mcp.json", "mcp.json", "settings.json", "settings.local.json", "hooks.json", "config.toml", "gemini-extension.json")
HEADER_VARIABLE = re.compile(r"\$\{?([A-Za-z_]\w*)", re.A)

STRING = re.compile(r"\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"")
COMMENT = re.compile(rf"{STRING.pattern}|(?P<comment>//[^\n\r]*|/\*[\s\S]*?\*/)")
QUOTED = re.compile(r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"?|'[^'\\]*+(?:\\.[^'\\]*+)*+'?")
ADDRESS = re.compile(r"(https?):[/\\]*([^/\\?#]*)", re.I)


def spaces(text: str) -> str:
    return re.sub(r"[^\n\r]", lambda m: "  " if m[0] > "\uffff" else " ", text)


def units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def parsed(text: str):
    """The value of strict JSON, or None."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None


def flat(value: str) -> str:
    """A string as it is shown: without quotes, line breaks and halves of pairs."""
    whole = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return re.sub(r"[\n\r]", " ", whole.replace('"', "'"))


def padded(shown: str, literal: str) -> str:
    return shown + " " * (units(literal) - units(shown))


def without_comments(text: str) -> str:
    return COMMENT.sub(lambda m: spaces(m[0]) if m["comment"] else m[0], text)


def decoded_strings(text: str) -> str:
    """JSON with every string decoded in place; empty if it isn't JSON."""
    if parsed(text) is None:
        return ""
    return STRING.sub(lambda m: padded(f'"{flat(json.loads(m[0], strict=False))}"', m[0]), text)


def startup_fields(text: str, name: str, path: str) -> str:
    """The lines of commands and arguments, with whole lists; of files that hold none, nothing."""
    if name not in STARTUP_FILES and not (name.endswith(".toml") and "commands" in path.split("/")):
        return ""
    if name.endswith(".json"):
        own = without_comments(text) if name == "settings.json" and ".gemini" in path.split("/") else text
        text = decoded_strings(own) or text
    out, depth = [], 0
    for line in text.split("\n"):
        inside = depth > 0
        if inside or STARTUP_FIELD.search(line):
            bare = QUOTED.sub("", line)
            depth += bare.count("[") - bare.count("]")
            depth = max(depth, 0)
            out.append(line)
        else:
            out.append(spaces(line))
    return "\n".join(out)


def host_of(url: str) -> str | None:
    """The host that a browser would call for a web address, or None."""
    m = ADDRESS.match(re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33))))))
    if not m:
        return None
    place = m[2].rpartition("@")[2]
    host, _, port = (place[: place.find("]") + 1], "", place[place.find("]") + 1 :].removeprefix(":")) if place.startswith("[") else place.partition(":")
    if port and not (port.isdecimal() and int(port) < 1 << 16):
        return None
    if host.startswith("["):
        try:
            return str(ipaddress.IPv6Address(host[1:-1]))
        except ValueError:
            return None
    host = unicodedata.normalize("NFKC", unquote(host)).lower()
    parts = host.removesuffix(".").split(".")
    if not re.fullmatch(r"\d+|0x[0-9a-f]*", parts[-1]):
        return host or None
    try:
        numbers = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8 if len(p) > 1 and p[0] == "0" else 10) for p in parts]
        *leading, last = numbers
        if len(numbers) > 4 or any(n > 255 for n in leading) or last >= 256 ** (5 - len(numbers)):
            return None
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(sum(n << 8 * (3 - i) for i, n in enumerate(leading)) + last))


def is_external(url: str) -> bool:
    host = host_of(url)
    return host is not None and host not in ("localhost", "::1") and not re.fullmatch(r"127(\.\d+){3}", host)


def sends_environment(hook: dict) -> bool:
    allowed = hook.get("allowedEnvVars")
    headers = hook.get("headers")
    if not isinstance(allowed, list) or not isinstance(headers, dict):
        return False
    named = {v for h in headers.values() if isinstance(h, str) for v in HEADER_VARIABLE.findall(h)}
    return bool(named & {a for a in allowed if isinstance(a, str)})


def hook_urls(text: str, with_environment: bool) -> str:
    """The addresses of web hooks outside this machine, wherever the file holds them; nothing else."""
    root = parsed(text)
    found, open_values = set(), [root.get("hooks")] if isinstance(root, dict) else []
    while open_values:
        value = open_values.pop()
        if isinstance(value, list):
            open_values += value
        elif isinstance(value, dict):
            open_values += value.values()
            url = value.get("url")
            if value.get("type") == "http" and isinstance(url, str) and is_external(url) and (not with_environment or sends_environment(value)):
                found.add(url)
    if not found:
        return ""
    out, at = [], 0
    for m in STRING.finditer(text):
        out.append(spaces(text[at : m.start()]))
        value = json.loads(m[0], strict=False)
        out.append(padded(f" {flat(value)}", m[0]) if value in found else spaces(m[0]))
        at = m.end()
    return "".join([*out, spaces(text[at:])])
