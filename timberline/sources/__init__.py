from .store import Store
from .wal import decode_wal, encode_wal

__all__ = ["Store", "decode_wal", "encode_wal"]
