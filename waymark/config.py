"""Settings of connectors, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ProxyConfig:
    host: str = "127.0.0.1"
    port: int = 4444
    timeout: float = 120.0
    delay: float = 5.0

    def __post_init__(self):
        if not self.host:
            raise ValueError("host must not be empty")
        _port(self.port)
        if self.timeout <= 0 or self.delay < 0:
            raise ValueError("timeout must be positive and delay not negative")

    @property
    def url(self) -> str:
        return f"http://{self.host}:{self.port}"


def _port(port: int) -> int:
    if not 0 < port < 65536:
        raise ValueError(f"port out of range: {port}")
    return port


@dataclass(frozen=True)
class TunnelConfig:
    """Where the ways to a destination listen, and the console and the language model."""

    proxy: ProxyConfig = ProxyConfig()
    socks_host: str = "127.0.0.1"
    socks_port: int = 4447
    sam_host: str = "127.0.0.1"
    sam_port: int = 9025
    sam_timeout: float = 60.0
    console: str = "http://127.0.0.1:7657"
    model_url: str = "http://127.0.0.1:11434"

    def __post_init__(self):
        _port(self.socks_port), _port(self.sam_port)
        if not (self.socks_host and self.sam_host):
            raise ValueError("hosts must not be empty")
        if self.sam_timeout <= 0:
            raise ValueError("timeout must be positive")

    @classmethod
    def of(cls, values: dict[str, str]) -> TunnelConfig:
        """From texts, as options and tables of settings hold them; unknown keys are errors."""
        kinds = {"socks_port": int, "sam_port": int, "sam_timeout": float, "socks_host": str, "sam_host": str, "console": str, "model_url": str}
        proxy = {k.removeprefix("proxy_"): v for k, v in values.items() if k in ("proxy_host", "proxy_port", "timeout")}
        own = {k: kinds[k](v) for k, v in values.items() if k in kinds}
        if unknown := set(values) - set(kinds) - {"proxy_host", "proxy_port", "timeout"}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        if "timeout" in values:
            own.setdefault("sam_timeout", float(values["timeout"]))
        return cls(ProxyConfig(**{k: {"port": int, "timeout": float}.get(k, str)(v) for k, v in proxy.items()}), **own)


def setting(table: DataFrame, key: str, default: str = "") -> str:
    """A value of a (key, value) table, or the default."""
    row = table.where(F.col("key") == key).select("value").first()
    return row.value if row and row.value is not None else default
