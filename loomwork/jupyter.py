"""IPython magics: %loom connects, %register names a file, %sql and %%sql run statements."""

from __future__ import annotations

from loomwork.session import Loom, remote, standalone


def load_ipython_extension(ip) -> None:
    from IPython.core.magic import Magics, line_cell_magic, line_magic, magics_class

    @magics_class
    class LoomMagics(Magics):
        loom: Loom | None = None

        def _loom(self) -> Loom:
            self.loom = self.loom or standalone()
            return self.loom

        @line_magic
        def loom_connect(self, line):
            self.loom = remote(line.strip()) if line.strip() else standalone()

        @line_magic
        def register(self, line):
            kind, name, path = line.split(maxsplit=2)
            self._loom().register(name, self._loom()._reader(kind, path))

        @line_cell_magic
        def sql(self, line, cell=None):
            out = list(self._loom().script(cell if cell is not None else line))
            return out[-1].toPandas() if out else None

    ip.register_magics(LoomMagics)
