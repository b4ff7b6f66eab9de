from .tables import read_table, write_table, load_results, save_results
from .model_store import load_model, save_model
from .fitted_store import load_fitted, save_fitted
