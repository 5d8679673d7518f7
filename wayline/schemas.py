"""Declared schemas of the sensor tables; nothing is inferred."""

from __future__ import annotations

POSES = (
    "run_id string, mark int, seconds double, lat double, lon double, height double, v_north double, v_east double, "
    "v_up double, rot_y double, rot_x double, azimuth double, week int, t_us bigint"
)
POINTS = "sweep_us bigint, x float, y float, z float, intensity float, laser int, dt_us int, t_us bigint"
RADAR = (
    "kind string, id int, dist double, lat_dist double, rel_spd double, dyn_prop double, rcs double, w double, l double, "
    "traj double, obst_probab double, exist_probab double, rel_acc double, type double, lost_reason double"
)
BOX = "x1 double, y1 double, x2 double, y2 double, score double, class_id int, track_id int"
TRACK_DUMP = "track int, boxes array<struct<frame bigint, xtl double, ytl double, xbr double, ybr double, lost int>>"
ANNOTATION_XML = (
    "image struct<name string, frameNr bigint>, annorect array<struct<x1 double, y1 double, x2 double, y2 double, "
    "score double, scale double, classID int, track_id int>>"
)
CALIBRATION = (
    "lidar struct<T_from_l_to_i array<array<double>>, height double>, "
    "cam array<struct<KK array<array<double>>, distort array<double>, E array<array<double>>, R array<array<double>>, "
    "displacement array<double>, width double, height double>>, "
    "radar struct<R array<array<double>>, T array<double>>"
)
MESSAGES = "ts timestamp, source string, payload string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
