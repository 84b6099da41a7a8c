"""Images as numpy arrays: PNG, grey, resizing, thresholds, regions, hashes and matching of descriptors.

An image is an array of height x width, or height x width x 3 for colours, of bytes.  What cannot
be read as PNG (other formats, interlaced or broken files) is None."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# ---- fixed values
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples for each pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in grey, of 65,536.
LUMA = (19595, 38470, 7471)
#: Longest side that is compared, side and low side of the hash's transform.
COMPARED_SIDE, HASH_SIDE, HASH_LOW = 512, 32, 8
#: Weights of the 5 x 5 blur, of 16.
BLUR = (1, 4, 6, 4, 1)
#: Share of the second distance below which a match stands.
LOWE = 0.75

#: Pixels that one image may have; a larger one is None (a file of some bytes can claim any size).
MOST_PIXELS = 1 << 27


# ---- PNG


def decode_png(blob: bytes | None) -> np.ndarray | None:
    if not blob or blob[:8] != SIGNATURE:
        return None
    at, packed, palette, head = 8, [], None, None
    try:
        while at + 8 <= len(blob):
            size, kind = struct.unpack(">I4s", blob[at : at + 8])
            body = blob[at + 8 : at + 8 + size]
            at += size + 12
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            elif kind == b"IEND":
                break
        width, height, depth, colour, _, _, interlaced = head
        if interlaced or not 0 < width * height <= MOST_PIXELS:
            return None
        bits = SAMPLES[colour] * depth
        stride = (width * bits + 7) // 8
        raw = zlib.decompressobj().decompress(b"".join(packed), height * (stride + 1))
        rows = _unfilter(np.frombuffer(raw, np.uint8).reshape(height, stride + 1), max(1, bits // 8))
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            each = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width]
            rows = (each * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
            if colour == 0:
                rows = rows * np.uint8(255 // ((1 << depth) - 1))
        if colour == 3:
            return palette[rows]
        shaped = rows.reshape(height, width, SAMPLES[colour])
        return shaped[:, :, 0].copy() if colour in (0, 4) else shaped[:, :, :3].copy()
    except (KeyError, TypeError, ValueError, IndexError, struct.error, zlib.error):
        return None


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of filtered rows; step: bytes from a sample to that of the pixel before."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for y, row in enumerate(rows):
        kind, line, above = row[0], row[1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            wide = np.zeros(-(-len(line) // step) * step, np.uint8)
            wide[: len(line)] = line
            out[y + 1] = np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            got, up = bytearray(step) + line.tobytes(), bytes(step) + above.tobytes()
            for i in range(step, len(got)):
                a, b, c = got[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                got[i] = (got[i] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(got[step:]), np.uint8)
        else:
            raise ValueError(kind)
    return out[1:]


def encode_png(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    lines = np.zeros((height, width * (image.ndim == 3 and 3 or 1) + 1), np.uint8)
    lines[:, 1:] = image.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


# ---- grey, size, frame


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((image.astype(np.int64) @ np.array(LUMA) + 0x8000) >> 16).astype(np.uint8)


def colours(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image


_KERNELS = {
    "bilinear": (1.0, lambda x: 1 - np.abs(x)),
    "lanczos": (3.0, lambda x: np.sinc(x) * np.sinc(x / 3)),
}


def _weights(have: int, want: int, kind: str) -> np.ndarray:
    """want x have: the share of each old place in each new one."""
    scale = have / want
    if kind == "area":
        edge = np.arange(want)[:, None] * scale
        covered = np.minimum(edge + scale, np.arange(have) + 1.0) - np.maximum(edge, np.arange(have))
        w = np.clip(covered, 0, None)
    else:
        reach, kernel = _KERNELS[kind]
        wide = max(scale, 1.0)
        x = (np.arange(have) + 0.5 - (np.arange(want)[:, None] + 0.5) * scale) / wide
        w = np.where(np.abs(x) < reach, kernel(x), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, kind: str = "bilinear") -> np.ndarray:
    """kind: bilinear or lanczos, widened where the image shrinks, or area, the mean of what a new pixel covers."""
    if image.shape[:2] == (height, width):
        return image
    rows, columns = _weights(image.shape[0], height, kind), _weights(image.shape[1], width, kind)
    got = np.einsum("yh,hw...->yw...", rows, image.astype(float), optimize=True)
    got = np.einsum("xw,yw...->yx...", columns, got, optimize=True)
    return np.clip(np.rint(got), 0, 255).astype(np.uint8)


def fitted(image: np.ndarray, side: int, kind: str = "bilinear") -> np.ndarray:
    """The image, made smaller if a side is longer than ``side``."""
    height, width = image.shape[:2]
    share = side / max(height, width)
    return image if share >= 1 else resize(image, max(1, int(width * share)), max(1, int(height * share)), kind)


def framed(image: np.ndarray, by: int = 25, value: int = 255) -> np.ndarray:
    return np.pad(image, ((by, by), (by, by)) + ((0, 0),) * (image.ndim - 2), constant_values=value)


def crop(image: np.ndarray, x: int, y: int, width: int, height: int, pad: int = 0) -> np.ndarray | None:
    """A box and ``pad`` pixels about it, cut to the image; None if nothing is left."""
    got = image[max(0, y - pad) : max(0, y + height + pad), max(0, x - pad) : max(0, x + width + pad)]
    return got if got.size else None


def network_input(image: np.ndarray, side: int = 128) -> np.ndarray:
    """1 x side x side x 3 of 32-bit shares of 255."""
    return (resize(colours(image), side, side) / np.float32(255)).astype(np.float32)[None]


# ---- thresholds and regions


def otsu(image: np.ndarray) -> int:
    """The least level whose split of the grey levels into those up to it and those above has the most variance between them."""
    n = np.bincount(image.reshape(-1), minlength=256).astype(float)
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def _spread(image: np.ndarray, weights: np.ndarray, mode: str) -> np.ndarray:
    """Weighted sums over rows, then columns."""
    reach = len(weights) // 2
    for axis in (0, 1):
        wide = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode=mode)
        image = sum(w * np.take(wide, np.arange(i, i + image.shape[axis]), axis) for i, w in enumerate(weights))
    return image


def blurred(image: np.ndarray) -> np.ndarray:
    mode = "reflect" if min(image.shape) > 2 else "edge"
    return ((_spread(image.astype(np.int64), np.array(BLUR), mode) + 128) >> 8).astype(np.uint8)


def dark_against_near(image: np.ndarray, side: int = 31, by: float = 5) -> np.ndarray:
    """Where a pixel is not more than the Gaussian mean of side x side pixels less ``by``."""
    spread = 0.3 * ((side - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-((np.arange(side) - side // 2) ** 2) / (2 * spread**2))
    mean = np.rint(_spread(image.astype(float), weights / weights.sum(), "edge"))
    return image <= mean - by


def dilated(marks: np.ndarray, side: int = 5, times: int = 1) -> np.ndarray:
    for _ in range(times):
        for axis in (0, 1):
            reach = side // 2
            wide = np.pad(marks, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)])
            marks = np.logical_or.reduce([np.take(wide, np.arange(i, i + marks.shape[axis]), axis) for i in range(side)])
    return marks


def closed(marks: np.ndarray, side: int = 5, times: int = 2) -> np.ndarray:
    """Dilated and then eroded; outside the image nothing is marked and nothing wears marks away."""
    return ~dilated(~dilated(marks, side, times), side, times)


def components(marks: np.ndarray) -> np.ndarray:
    """n x 5: x, y, width, height and area of the marked regions that touch by side or corner, in the order of their first pixels."""
    height, width = marks.shape
    step = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    if not len(row):
        return np.zeros((0, 5), np.int64)
    wide = width + 2
    first = np.searchsorted(row * wide + end, (row + 1) * wide + start)
    behind = np.searchsorted(row * wide + start, (row + 1) * wide + end, "right")
    n = np.maximum(behind - first, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)
    least = np.arange(len(row))
    while True:
        low = np.minimum(least[a], least[b])
        told = least.copy()
        np.minimum.at(told, least[a], low)
        np.minimum.at(told, least[b], low)
        told = told[told]
        if (told == least).all():
            break
        least = told
    at, which = np.unique(least, return_inverse=True)

    def folded(f, values, begin):
        out = np.full(len(at), begin)
        f.at(out, which, values)
        return out

    x0, y0 = folded(np.minimum, start, width), folded(np.minimum, row, height)
    x1, y1 = folded(np.maximum, end, 0), folded(np.maximum, row + 1, 0)
    return np.stack([x0, y0, x1 - x0, y1 - y0, np.bincount(which, end - start, len(at)).astype(np.int64)], axis=1)


def page_marks(image: np.ndarray) -> np.ndarray:
    """What stands out from a page, gaps closed."""
    return closed(dark_against_near(blurred(grey(image))))


# ---- hashes and matching


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits, signed: which of the low frequencies of the image at 32 x 32 are above their median."""
    small = resize(grey(image), HASH_SIDE, HASH_SIDE, "lanczos").astype(float)
    turn = np.cos(np.pi / HASH_SIDE * np.arange(HASH_LOW)[:, None] * (np.arange(HASH_SIDE) + 0.5))
    low = (turn @ small @ turn.T).reshape(-1)
    return int(np.packbits(low > np.median(low)).view(">i8")[0])


def compared(image: np.ndarray) -> np.ndarray:
    return fitted(grey(image), COMPARED_SIDE)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each descriptor (row of bytes) of a against each of b."""
    return np.stack([np.bitwise_count(row ^ b).sum(1, dtype=np.int64) for row in a]) if len(a) and len(b) else np.zeros((len(a), len(b)), np.int64)


def mutual_matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n x 3: row of a, row of b, distance, of those nearest to each other; ties go to the first."""
    d = distances(a, b)
    if not d.size:
        return np.zeros((0, 3), np.int64)
    there, back = d.argmin(1), d.argmin(0)
    i = np.nonzero(back[there] == np.arange(len(a)))[0]
    return np.stack([i, there[i], d[i, there[i]]], axis=1)


def clear_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Rows of a whose nearest row of b is nearer than LOWE of the distance of the second."""
    d = distances(a, b)
    if d.shape[1] < 2:
        return 0
    two = np.partition(d, 1, axis=1)[:, :2]
    return int((two[:, 0] < LOWE * two[:, 1]).sum())


def mutual_score(a: np.ndarray, b: np.ndarray, least_points: int, least_matches: int, share: float = 0.15) -> float:
    """1 - mean distance / 100 of the nearest matches: a share of them, but at least ``least_matches``."""
    if min(len(a), len(b)) < least_points:
        return 0.0
    found = np.sort(mutual_matches(a, b)[:, 2])
    if not len(found) or len(found) < least_matches:
        return 0.0
    return float(np.clip(1 - found[: max(least_matches, int(len(found) * share))].mean() / 100, 0, 1))


def clear_score(a: np.ndarray, b: np.ndarray, least_points: int, least_matches: int) -> float:
    """Clear matches by the lesser number of key points."""
    fewer = min(len(a), len(b))
    if fewer < max(1, least_points):
        return 0.0
    good = clear_matches(a, b)
    return 0.0 if good < least_matches else float(np.clip(good / fewer, 0, 1))
