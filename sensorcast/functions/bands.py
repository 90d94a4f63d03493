"""Mapping a number to a quality band."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    upper: float | None  # inclusive; None for the open last band
    label: str
    colour: str | None = None
    advice: str | None = None


# Band limits and texts shown to the public.
AQI_BANDS = (
    Band(20, "Không khí trong lành", "green", "Bạn có thể sinh hoạt và vận động ngoài trời bình thường."),
    Band(40, "Chất lượng khá", "green", "Nhìn chung an toàn cho mọi người."),
    Band(60, "Cần lưu ý", "yellow", "Người nhạy cảm nên giảm vận động mạnh ngoài trời."),
    Band(80, "Không khí kém", "orange", "Nên hạn chế hoạt động ngoài trời kéo dài."),
    Band(100, "Không khí rất kém", "red", "Trẻ em, người cao tuổi và người bệnh hô hấp nên ở trong nhà."),
    Band(None, "Ô nhiễm nghiêm trọng", "red", "Hạn chế ra ngoài và đóng cửa sổ nếu có thể."),
)
PM25_BANDS = (
    Band(10, "Thấp", "green", "Mức bụi mịn dự kiến thấp, phù hợp cho hoạt động ngoài trời."),
    Band(20, "Khá", "green", "Chất lượng không khí dự kiến nhìn chung chấp nhận được."),
    Band(25, "Cần lưu ý", "yellow", "Người nhạy cảm nên cân nhắc giảm vận động mạnh ngoài trời."),
    Band(50, "Cao", "orange", "Nên hạn chế hoạt động ngoài trời kéo dài."),
    Band(75, "Rất cao", "red", "Nhóm nhạy cảm nên ở trong nhà và giảm tiếp xúc không khí ngoài trời."),
    Band(None, "Nghiêm trọng", "red", "Hạn chế ra ngoài; dự báo này cần được theo dõi sát."),
)
SIMPLE_AQI_BANDS = (
    Band(50, "Tốt"),
    Band(100, "Trung bình"),
    Band(150, "Kém"),
    Band(200, "Xấu"),
    Band(None, "Rất xấu"),
)
# Lowest R² (inclusive) for each rating of a forecast.
RATINGS = ((0.85, "Rất xuất sắc"), (0.75, "Tốt"), (0.65, "Khá tốt"))
LOWEST_RATING = "Đạt yêu cầu"


def _choose(value: Column, bands: tuple[Band, ...], pick) -> Column:
    """CASE over the bands in ascending order; null and NaN stay without a band."""
    chosen = None
    for band in bands:
        known = F.lit(True) if band.upper is None else value <= F.lit(float(band.upper))
        test = value.isNotNull() & ~F.isnan(value) & known
        chosen = F.when(test, pick(band)) if chosen is None else chosen.when(test, pick(band))
    return chosen


def band_label(value: Column, bands: tuple[Band, ...]) -> Column:
    return _choose(value, bands, lambda band: F.lit(band.label))


def band_level(value: Column, bands: tuple[Band, ...]) -> Column:
    """Position of the band, 0 for the lowest: comparable, unlike the label."""
    level = {band: i for i, band in enumerate(bands)}
    return _choose(value, bands, lambda band: F.lit(level[band]))


def band_guidance(value: Column, bands: tuple[Band, ...]) -> Column:
    """Struct of label, colour and advice."""

    def pick(band):
        return F.struct(
            F.lit(band.label).alias("label"),
            F.lit(band.colour).cast("string").alias("colour"),
            F.lit(band.advice).cast("string").alias("advice"),
        )

    return _choose(value, bands, pick)


def rating(r2: Column) -> Column:
    """Verdict on a forecast from its R²."""
    chosen = F
    for lowest, label in RATINGS:
        chosen = chosen.when(r2 >= F.lit(lowest), F.lit(label))
    return chosen.when(r2.isNotNull(), F.lit(LOWEST_RATING))
