"""Settings of a store, as JSON with fixed names of its fields."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field


class ConfigNotFound(FileNotFoundError):
    """There is no configuration, or an empty one."""


class ConfigInvalid(ValueError):
    """The configuration is no valid JSON or has unknown or missing fields."""


@dataclass(frozen=True)
class TableConfig:
    block_num_limit: int = 512  # 4 KiB blocks of a run file: its target size


@dataclass(frozen=True)
class LevelConfig:
    level_zero_num_limit: int = 4
    level_ratio: int = 4
    table_config: TableConfig = field(default_factory=TableConfig)


@dataclass(frozen=True)
class StorageConfig:
    memtable_size_limit: int = 2 << 20
    level_config: LevelConfig = field(default_factory=LevelConfig)


@dataclass(frozen=True)
class Config:
    lsm_storage_config: StorageConfig = field(default_factory=StorageConfig)
    request_queue_len: int = 500
    imm_num_limit: int = 2
    thread_sleep_time: int = 100
    request_queue_size: int = 1000  # bytes that make the writer commit
    auto_compact: bool = True

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str | None) -> "Config":
        if not text:
            raise ConfigNotFound("empty configuration")
        try:
            d = dict(json.loads(text))
            s = dict(d.pop("lsm_storage_config"))
            level = dict(s.pop("level_config"))
            table = TableConfig(**level.pop("table_config"))
            return Config(lsm_storage_config=StorageConfig(level_config=LevelConfig(table_config=table, **level), **s), **d)
        except (ValueError, TypeError, KeyError) as e:
            raise ConfigInvalid(str(e)) from e


def enable_log(level: int | str = logging.INFO) -> logging.Logger:
    """The package's logger, told to standard error from ``level`` on."""
    logger = logging.getLogger("tidelog")
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        logger.addHandler(handler)
    logger.setLevel(level)
    return logger
