"""Time-series anomaly analytics on Spark: windows scored by local energy, then time-frequency analysis of what stands out."""

from .functions.tfr import msst_stft
from .operators.periods import prepare_analysis_periods
from .plans.analyze import analyze_msst_periods
from .plans.detect import detect_energy_anomalies
from .plans.figures import plot_msst_periods, plot_suspicious_windows, plot_window

__all__ = ["analyze_msst_periods", "detect_energy_anomalies", "msst_stft", "plot_msst_periods", "plot_suspicious_windows", "plot_window", "prepare_analysis_periods"]
