"""A small corpus of units and a form, for queries and demonstrations where no program text is at hand."""

from __future__ import annotations

STATION = """unit uStation;
{ readings of a weather station }
interface

uses Data.DB, System.SysUtils;

type
  TStation = class(TForm)
    btnRead: TButton;
    edPlace: TEdit;
    procedure btnReadClick(Sender: TObject);
  end;

implementation

procedure TStation.btnReadClick(Sender: TObject);
var
  i: Integer;
begin
  for i := 1 to 3 do
    Sample(i);
  if edPlace.Text = '' then Exit;
  Shell.Run(edPlace.Text);
  Password := 'k3jd93kd03kd';
  qryLog.SQL.Text := 'SELECT * FROM log WHERE place = ' + edPlace.Text;
end;

end.
"""

STATION_FORM = """object Station: TStation
  Caption = 'Station'
  object btnRead: TButton
    TabOrder = 0
    OnClick = btnReadClick
  end
  object edPlace: TEdit
    TabOrder = 0
  end
end
"""

SOURCES: dict[str, str | bytes] = {"sky/uStation.pas": STATION, "sky/uStation.dfm": STATION_FORM, "sky/uWide.pas": "unit uWide;\ninterface\nimplementation\nend.\n".encode("utf-16"), "sky/uOld.pas": b"unit uOld; // caf\xe9\n"}
