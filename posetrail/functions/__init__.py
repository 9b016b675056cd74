"""Scalar functions of the library as columns."""

from posetrail.operators.files import day_number, image_frame, image_path, integers, normal_name, path_levels, prediction_name
from posetrail.operators.numbers import clipped, polar, round_half_up, seconds, sigmoid

__all__ = ["clipped", "day_number", "image_frame", "image_path", "integers", "normal_name", "path_levels", "polar", "prediction_name", "round_half_up", "seconds", "sigmoid"]
