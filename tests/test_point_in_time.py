"""Nothing before t may move when the rows after t are changed."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapegrain.functions import indicators as I
from tapegrain.operators import factors as X
from tapegrain.operators import regimes as R
from tapegrain.operators import structure as S

CUT = "2020-11-02"

CASES = {
    "indicators": (lambda b: I.with_indicators(b, ["sma_20", "ema_12", "rsi_14", "macd", "bb_20", "atr_14", "stoch_14_3"]), ["sma_20", "ema_12", "rsi_14", "macd_hist", "bb_pctb", "atr_14", "stoch_d"]),
    "features": (X.feature_block, ["ret_21", "vol_21", "sma_gap_50", "vol_z_20", "drawdown_252"]),
    "event_features": (X.event_features, X.EVENT_FEATURES),
    "regime": (R.daily_regime, ["trend", "vol_state", "regime"]),
    "sweeps": (lambda b: S.sweeps(S.swings(S.with_structure_base(b))).where(F.col("session") < "2020-10-20"), ["direction", "swept_level"]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_future_rows_do_not_matter(bars, name):
    fn, cols = CASES[name]
    late = F.col("session") >= F.lit(CUT).cast("date")
    poisoned = bars.withColumns({x: F.when(late, F.col(x) * 3.7).otherwise(F.col(x)) for x in ("open", "high", "low", "close", "volume")})
    keep = lambda b: fn(b).where(F.col("session") < CUT).select("symbol", "session", *cols).toPandas().sort_values(["symbol", "session", *cols[:1]]).reset_index(drop=True)
    pd.testing.assert_frame_equal(keep(bars), keep(poisoned))


def test_lagging_line_is_the_only_look_ahead_of_the_chart(bars):
    late = F.col("session") >= F.lit(CUT).cast("date")
    poisoned = bars.withColumn("close", F.when(late, F.col("close") * 3).otherwise(F.col("close")))
    a, b = (I.add_ichimoku(x).where(F.col("session") < CUT).toPandas().sort_values(["symbol", "session"]).reset_index(drop=True) for x in (bars, poisoned))
    assert not a["ichi_lagging"].equals(b["ichi_lagging"])
    pd.testing.assert_frame_equal(a.drop(columns="ichi_lagging"), b.drop(columns="ichi_lagging"))
