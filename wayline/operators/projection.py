"""World points in camera images: world, vehicle, lidar, camera, pixel.

Each frame looks only at those cells of points that its view can touch, from
coarse cells to fine ones, so frames and points never meet as a product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions import camera as cam, rotation
from wayline.operators import pyramid, spatial
from wayline.session import cut_lineage

XYZ = ["x", "y", "z"]
#: cameras of a rig table that may be broadcast, once counted
MOST_CAMERAS = 1000

CHAIN = [f"a{i}{j}" for i in range(3) for j in range(3)] + ["b0", "b1", "b2"]
LENS = ["fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3"]


def view_radius(focal: Sequence[float], centre: Sequence[float], distort: Sequence[float], size: Sequence[float]) -> float:
    """Largest x, y distance from the axis, at depth one, that can show up inside the image.

    Outside it the distorted point lies beyond the image's farthest corner. A
    distortion that folds far points back into the image widens it; one that
    never leaves the image for good gives infinity.
    """
    k1, k2, p1, p2, k3 = map(float, distort)
    corner = max(np.hypot((u - centre[0]) / focal[0], (v - centre[1]) / focal[1]) for u in (-1.0, size[0]) for v in (-1.0, size[1]))
    radial = np.array([k3, 0.0, k2, 0.0, k1, 0.0, 1.0, 0.0])  # r (1 + k1 r^2 + k2 r^4 + k3 r^6), highest power first
    side = np.zeros(8)
    side[5] = np.sqrt(10.0) * (abs(p1) + abs(p2))  # the tangential part is no longer than this times r^2
    end = np.zeros(8)
    end[7] = corner
    for sign in (1.0, -1.0):
        outside = np.trim_zeros(sign * radial - side - end, "f")
        if outside[0] > 0:
            roots = np.roots(outside)
            real = roots[np.abs(roots.imag) < 1e-9 * (1 + np.abs(roots.real))].real
            return float(max([r for r in real if r > 0], default=0.0)) * (1 + 1e-6) + 1e-6
    return float("inf")


def camera_chains(cameras: DataFrame, keys: Sequence[str] = ("camera",)) -> DataFrame:
    """One row per camera: vehicle to camera as ``a00..a22, b0..b2``, the lens, the image size and ``cone``.

    ``cameras`` holds the calibration as nested in its files, row by row:
    ``lidar_to_vehicle`` (16 numbers), ``displacement`` (3, lidar to camera in the
    lidar frame), ``rotation`` (9, after the change of axes from forward, left,
    up to right, down, forward), ``extrinsic`` (16), ``matrix`` (9), ``distort``
    (5: k1, k2, p1, p2, k3), ``width`` and ``height``. All turns have to be
    rotations, which keep distances.
    """
    keys = list(keys)
    types = dict(cameras.dtypes)
    out = [*CHAIN, *LENS, "width", "height", "cone"]
    axes = np.array([[0.0, -1.0, 0.0], [0.0, 0.0, -1.0], [1.0, 0.0, 0.0]])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                to_lidar = np.linalg.inv(np.reshape(r.lidar_to_vehicle, (4, 4)))
                turn, extrinsic, lens = np.reshape(r.rotation, (3, 3)) @ axes, np.reshape(r.extrinsic, (4, 4)), np.reshape(r.matrix, (3, 3))
                a = extrinsic[:3, :3] @ turn @ to_lidar[:3, :3]
                shift = extrinsic[:3, :3] @ turn @ (to_lidar[:3, 3] + np.asarray(r.displacement)) + extrinsic[:3, 3]
                focal, centre = (lens[0, 0], lens[1, 1]), (lens[0, 2], lens[1, 2])
                rows.append([*a.ravel(), *shift, *focal, *centre, *r.distort, r.width, r.height, view_radius(focal, centre, r.distort, (r.width, r.height))])
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(rows, columns=out, dtype=float)], axis=1)

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{c} double" for c in out]])
    return cameras.mapInPandas(solve, schema)


def project_map(
    points: DataFrame, frames: DataFrame, cameras: DataFrame, keys: Sequence[str], ident: str, frame: str, camera: str = "camera",
    time: str | None = None, window: float | None = None, finest: float = 8.0, margin: int = 2, min_dist2: float = 3.0,
) -> DataFrame:
    """Pixels of world points in the frames that see them: keys, frame, camera, point, ``u``, ``v`` (whole pixels) and ``depth``.

    ``points`` hold x, y, z; ``frames`` the camera, the vehicle's position px, py,
    pz and its turn to the world r00..r22; ``cameras`` a row per camera as in
    :func:`camera_chains`. With ``time`` only points nearer than ``window`` in time
    count. A pixel is rounded to the nearest whole one (halves to even), then has
    to lie ``margin`` inside the image, in front of the camera, at a squared
    distance above ``min_dist2``. Points and frames with numbers that are not
    finite see nothing.
    """
    keys = list(keys)
    rig = cut_lineage(camera_chains(cameras, [camera]))
    rig = F.broadcast(rig) if rig.count() <= MOST_CAMERAS else rig
    turn = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    poses = spatial.usable(frames, ["px", "py", "pz", *[f"r{i}{j}" for i in range(3) for j in range(3)]]).join(rig, camera)
    # camera = A R' (p - t) + b = M p + v
    chain = rotation.mat_mul([[F.col(f"a{i}{j}") for j in range(3)] for i in range(3)], rotation.transpose(turn))
    poses = poses.withColumns({f"m{i}{j}": rotation.as_column(chain[i][j]) for i in range(3) for j in range(3)})
    moved = rotation.mat_vec([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)], [F.col("p" + c) for c in XYZ])
    poses = poses.withColumns({f"v{i}": F.col(f"b{i}") - rotation.as_column(moved[i]) for i in range(3)})
    cols = [f"m{i}{j}" for i in range(3) for j in range(3)] + ["v0", "v1", "v2", *LENS, "width", "height", "cone"]
    asked = poses.select(*keys, F.col(frame).alias("_frame"), camera, *([F.col(time).alias("_t")] if time else []), *cols)

    seen = points.select(*keys, F.col(ident).alias("_point"), *([F.col(time).alias("_pt")] if time else []), *XYZ)
    seen = cut_lineage(spatial.usable(seen, XYZ))
    levels = pyramid.build(seen, keys, XYZ, finest, ranges=["_pt"] if time else [])

    def in_camera(p: Sequence[Column]) -> list[Column]:
        m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
        return [rotation.as_column(x) + F.col(f"v{i}") for i, x in enumerate(rotation.mat_vec(m, p))]

    def touched(d: DataFrame) -> DataFrame:
        x, y, z = in_camera([pyramid.middle(c) for c in XYZ])
        radius = pyramid.half_diagonal(XYZ) * (1 + 1e-9) + 1e-9
        ahead = z + radius
        d = d.where((ahead > 0) & (F.sqrt(x * x + y * y) - radius <= F.col("cone") * ahead))
        return d.where((F.col("_lo__pt") < F.col("_t") + window) & (F.col("_hi__pt") > F.col("_t") - window)) if time else d

    pairs = pyramid.descend(asked, levels, keys, XYZ, touched).join(spatial.with_cell(seen, XYZ, finest), [*keys, *spatial.cell_names(XYZ)])
    if time:
        pairs = pairs.where(F.abs(F.col("_pt") - F.col("_t")) < window)
    lens = [F.col(c) for c in LENS]
    d = cam.with_pixels(pairs, in_camera([F.col(c) for c in XYZ]), lens[:2], lens[2:4], lens[4:])
    d = d.where(cam.visible(F.col("width"), F.col("height"), margin, min_dist2))
    return d.select(
        *keys, F.col("_frame").alias(frame), camera, F.col("_point").alias(ident),
        F.rint("u").cast("int").alias("u"), F.rint("v").cast("int").alias("v"), F.col("cam_z").alias("depth"),
    )
