"""Sending payloads: addresses, credentials and token exchanges of the channels. Used with ``payloads.publish``."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import secrets
import time
from collections.abc import Callable
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

HTTP_SECONDS, SMTP_SECONDS, EARLY = 10, 15, 60
# fixed addresses of the channels
TELEGRAM = "https://api.telegram.org/bot{}/sendMessage"
PAGERDUTY = "https://events.pagerduty.com/v2/enqueue"
NOTION, NOTION_VERSION = "https://api.notion.com/v1/pages", "2022-06-28"
REDDIT_TOKEN, REDDIT = "https://www.reddit.com/api/v1/access_token", "https://oauth.reddit.com/api/submit"
X = "https://api.x.com/2/tweets"
GOOGLE_TOKEN = "https://oauth2.googleapis.com/token"
SHEETS, SHEETS_SCOPE = "https://sheets.googleapis.com/v4/spreadsheets/{}/values/{}:append?valueInputOption=RAW&insertDataOption=INSERT_ROWS", "https://www.googleapis.com/auth/spreadsheets"
DOCS, DOCS_SCOPE = "https://docs.googleapis.com/v1/documents/{}:batchUpdate", "https://www.googleapis.com/auth/documents"


class SendError(Exception):
    """A channel that didn't take a payload; ``status`` is that of the answer, if there was one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message[:200])
        self.status = status


def http(method: str, url: str, headers: dict[str, str], body: bytes, seconds: float = HTTP_SECONDS) -> tuple[int, str]:
    """Status and text of an answer, whatever the status."""
    try:
        with urlopen(Request(url, body, headers, method=method), timeout=seconds) as answer:  # noqa: S310
            return answer.status, answer.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def value(secret: str | Callable[[], str]) -> str:
    """A secret that is given as it is, or by a function."""
    return secret() if callable(secret) else secret


def percent(text: str) -> str:
    return quote(text, safe="-._~")


def signed_header(options: dict, method: str, url: str, at: int, nonce: str | None = None) -> str:
    """An OAuth 1.0a header (HMAC-SHA1) for a request whose body isn't signed."""
    fields = {
        "oauth_consumer_key": value(options["api_key"]), "oauth_nonce": nonce or secrets.token_hex(16), "oauth_signature_method": "HMAC-SHA1",
        "oauth_timestamp": str(at), "oauth_token": value(options["access_token"]), "oauth_version": "1.0",
    }
    base = "&".join(map(percent, (method, url, "&".join(f"{percent(k)}={percent(v)}" for k, v in sorted(fields.items())))))
    key = f"{percent(value(options['api_secret']))}&{percent(value(options['access_token_secret']))}"
    fields["oauth_signature"] = base64.b64encode(hmac.digest(key.encode(), base.encode(), "sha1")).decode()
    return "OAuth " + ", ".join(f'{percent(k)}="{percent(v)}"' for k, v in sorted(fields.items()))


def der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """Tag, content and end of the DER element at ``at``."""
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return tag, data[at : at + size], at + size


def rsa_numbers(pem: str) -> tuple[int, int]:
    """Modulus and private exponent of a key in PKCS #8."""
    raw = base64.b64decode(re.sub(r"-----[^-]+-----|\s", "", pem))
    _, info, _ = der(raw)
    _, _, at = der(info)
    _, _, at = der(info, at)
    _, key, _ = der(der(info, at)[1])
    numbers, at = [], 0
    while len(numbers) < 4:
        _, n, at = der(key, at)
        numbers.append(int.from_bytes(n, "big"))
    return numbers[1], numbers[3]


def rs256(message: bytes, pem: str) -> bytes:
    """RSASSA-PKCS1-v1_5 with SHA-256. Plain integer arithmetic, so not for where its timing can be observed."""
    n, d = rsa_numbers(pem)
    size = (n.bit_length() + 7) // 8
    # the fixed prefix says: SHA-256
    digest = bytes.fromhex("3031300d060960864801650304020105000420") + hashlib.sha256(message).digest()
    padded = b"\x00\x01" + b"\xff" * (size - len(digest) - 3) + b"\x00" + digest
    return pow(int.from_bytes(padded, "big"), d, n).to_bytes(size, "big")


def url64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def assertion(email: str, pem: str, scope: str, at: int) -> str:
    """The token by which a service account asks for access, good for an hour."""
    parts = ({"alg": "RS256", "typ": "JWT"}, {"iss": email, "scope": scope, "aud": GOOGLE_TOKEN, "iat": at, "exp": at + 3600})
    text = ".".join(url64(json.dumps(p, separators=(",", ":")).encode()) for p in parts)
    return f"{text}.{url64(rs256(text.encode(), pem))}"


class Sender:
    """Sends a payload to its channel, as ``send`` of ``payloads.publish``; raises ``SendError`` where that fails.

    ``options`` has what each channel needs: ``url`` (slack, discord, teams, googlechat, webhook; the last also
    ``method`` and ``headers``), ``token`` and ``chat_id`` (telegram), ``routing_key`` (pagerduty), ``token``,
    ``database_id`` and ``names`` of properties (notion), ``client_id``, ``client_secret``, ``username``, ``password``,
    ``subreddit`` (reddit), ``bearer`` or the four OAuth 1.0a values (x), ``spreadsheet_id``, ``range`` or
    ``document_id``, with ``access_token`` or ``email`` and ``private_key`` (Google), and ``host``, ``port``,
    ``security`` (``tls``, ``starttls``, ``none``), ``username``, ``password``, ``sender``, ``recipients`` (email).
    Secrets are strings or functions.

    Tokens are kept per process until a minute before they end and aren't pickled. Times are those of the clock.
    """

    def __init__(self, options: dict[str, dict], transport: Callable = http, clock: Callable[[], float] = time.time):
        self.options, self.transport, self.clock, self.tokens = options, transport, clock, {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tokens": {}}

    def __call__(self, channel: str, alert_id: str, payload: str) -> None:
        if channel not in self.options:
            raise SendError(f"no options for channel {channel}")
        getattr(self, channel, self.plain)(self.options[channel], payload)

    def post(self, url: str, body: bytes, headers: dict[str, str] | None = None, method: str = "POST", kind: str = "application/json") -> str:
        status, text = self.transport(method, url, {"Content-Type": kind, **(headers or {})}, body)
        if not 200 <= status < 300:
            raise SendError(f"HTTP {status}: {text}", status)
        return text

    def form(self, url: str, fields: dict, headers: dict[str, str] | None = None) -> str:
        return self.post(url, urlencode(fields).encode(), headers, kind="application/x-www-form-urlencoded")

    def token(self, key: str, ask: Callable[[], str]) -> str:
        """The access token of ``key``: the one that is kept, or a new one from the answer to ``ask``."""
        kept = self.tokens.get(key)
        if kept and kept[1] > self.clock():
            return kept[0]
        try:
            answer = json.loads(ask())
            found, lasts = answer["access_token"], answer.get("expires_in", 3600)
        except (ValueError, KeyError, TypeError, AttributeError):
            raise SendError("the answer holds no access_token") from None
        self.tokens[key] = (found, self.clock() + lasts - EARLY)
        return found

    def plain(self, o: dict, payload: str) -> None:
        self.post(value(o["url"]), payload.encode())

    def webhook(self, o: dict, payload: str) -> None:
        self.post(value(o["url"]), payload.encode(), o.get("headers"), o.get("method", "POST"))

    def telegram(self, o: dict, payload: str) -> None:
        self.post(TELEGRAM.format(value(o["token"])), json.dumps({"chat_id": o["chat_id"], **json.loads(payload)}).encode())

    def pagerduty(self, o: dict, payload: str) -> None:
        self.post(PAGERDUTY, json.dumps({"routing_key": value(o["routing_key"]), **json.loads(payload)}).encode())

    def notion(self, o: dict, payload: str) -> None:
        names = o.get("names", {})
        properties = {names.get(k, k): v for k, v in json.loads(payload)["properties"].items()}
        body = {"parent": {"database_id": o["database_id"]}, "properties": properties}
        self.post(NOTION, json.dumps(body).encode(), {"Authorization": f"Bearer {value(o['token'])}", "Notion-Version": NOTION_VERSION})

    def reddit(self, o: dict, payload: str) -> None:
        agent, key = {"User-Agent": o.get("user_agent", "tidemark/1")}, f"reddit:{o['client_id']}"

        def ask() -> str:
            basic = base64.b64encode(f"{o['client_id']}:{value(o['client_secret'])}".encode()).decode()
            return self.form(REDDIT_TOKEN, {"grant_type": "password", "username": o["username"], "password": value(o["password"])}, {"Authorization": f"Basic {basic}", **agent})

        def submit() -> None:
            self.form(REDDIT, {"sr": o["subreddit"], **json.loads(payload)}, {"Authorization": f"Bearer {self.token(key, ask)}", **agent})

        try:
            submit()
        except SendError as e:
            if e.status != 401 or key not in self.tokens:
                raise
            del self.tokens[key]  # ended early: once more, with a new one
            submit()

    def x(self, o: dict, payload: str) -> None:
        header = f"Bearer {value(o['bearer'])}" if "bearer" in o else signed_header(o, "POST", X, int(self.clock()))
        self.post(X, payload.encode(), {"Authorization": header})

    def google(self, o: dict, scope: str) -> dict[str, str]:
        if "access_token" in o:
            return {"Authorization": f"Bearer {value(o['access_token'])}"}
        ask = lambda: self.form(GOOGLE_TOKEN, {"grant_type": "urn:ietf:params:oauth:grant-type:jwt-bearer", "assertion": assertion(o["email"], value(o["private_key"]), scope, int(self.clock()))})
        return {"Authorization": f"Bearer {self.token(f'google:{o["email"]}:{scope}', ask)}"}

    def googlesheets(self, o: dict, payload: str) -> None:
        self.post(SHEETS.format(o["spreadsheet_id"], quote(o.get("range", "Sheet1"), safe="")), payload.encode(), self.google(o, SHEETS_SCOPE))

    def googledocs(self, o: dict, payload: str) -> None:
        body = json.loads(payload)
        for request in body["requests"]:
            request["insertText"]["endOfSegmentLocation"] = {"segmentId": ""}
        self.post(DOCS.format(o["document_id"]), json.dumps(body).encode(), self.google(o, DOCS_SCOPE))

    def email(self, o: dict, payload: str) -> None:
        import smtplib

        secure = o.get("security", "starttls")
        make = smtplib.SMTP_SSL if secure == "tls" else smtplib.SMTP
        with make(o["host"], o.get("port", 465 if secure == "tls" else 587), timeout=SMTP_SECONDS) as server:
            if secure == "starttls":
                server.starttls()
            if o.get("username"):
                server.login(o["username"], value(o["password"]))
            # the client doubles dots itself
            server.sendmail(o["sender"], o["recipients"], re.sub(r"(?m)^\.\.", ".", payload).encode())
