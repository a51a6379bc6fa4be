"""Builders of small fixed-width structure texts."""


def atom_line(serial, atom, res, chain, res_no, x, y, z, element="", altloc=" ", icode=" ", record="ATOM"):
    return (
        f"{record:<6}{serial:>5} {atom:^4}{altloc}{res:>3} {chain}{res_no:>4}{icode}   "
        f"{x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{0.0:6.2f}          {element:>2}"
    )


THREE = dict(zip("ARNDCQEGHILKMFPSTWYV", (
    "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split())))


def ca_text(sequence, chain="A"):
    lines = [
        atom_line(i, "CA", THREE[c], chain, i, float(i), 0.0, 0.0, "C")
        for i, c in enumerate(sequence, 1)
    ]
    return "\n".join([*lines, "END", ""])


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(text)
    return path
