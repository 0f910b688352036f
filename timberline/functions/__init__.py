from .keys import be64_decode, be64_encode, common_prefix_length, file_name, padded, raw_length
from .bloom import bloom_bitmap, bloom_build, bloom_positions, bloom_probe, bloom_shape, bloom_unpack

__all__ = ["be64_decode", "be64_encode", "bloom_bitmap", "bloom_build", "bloom_positions", "bloom_probe", "bloom_shape", "bloom_unpack", "common_prefix_length", "file_name", "padded", "raw_length"]
