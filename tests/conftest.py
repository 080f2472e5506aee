import pytest

from tessaline.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("local[4]", 4, **{"spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
