"""Models reach executors that have no copy of the package."""

import subprocess
import sys
import tempfile

from pyspark import cloudpickle

from raceframe.llm import language, pii


def _elsewhere(value, code):
    """Run code on the sent value in a Python that cannot import the package."""
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/sent", "wb") as f:
            f.write(cloudpickle.dumps(value))
        done = subprocess.run([sys.executable, "-c", f"import pickle, sys\nx = pickle.load(open('sent', 'rb'))\n{code}\nassert 'raceframe' not in sys.modules"], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_decoder_and_its_search():
    _elsewhere((pii.train(), pii.find_spans), "assert x[1]('mail me: joe@example.com now', x[0])[0][:3] == ('email', 9, 24)")


def test_language_model_and_its_prediction():
    model = language.fit(["the and of house water"] * 3 + ["der und die haus wasser"] * 3, ["en"] * 3 + ["de"] * 3)
    _elsewhere((model, language.predict), "import pyarrow as pa\nassert x[1](x[0], pa.array(['the house', 'µ']))[0][0] == 'en'")
